import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import doc_stats, quality_classifier, quality_rules
from chronofold.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n\t ", "one", "a b c a b c a b c", "line\nline\n\n  \nline \nother", "x" * 3000, "é ü\u00a0ß 日本 語\n日本 語", "a\x0bb\x0cc\rd", "# * $ % & | < >", "tail\n", "\nhead", "A a A a A a"]


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def corpus(n=400):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        good = rng.random() < 0.7
        if not good:
            words = [w + rng.choice(["***", "###", "!!"]) if rng.random() < 0.7 else w.upper() for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(1, *r, True, -1) for r in rows], "y int, doc_id long, text string, kept boolean, part int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_base_counts_against_plain_python():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "b", "c ", " ", "\n", "#", "é"]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    import pyarrow as pa

    parts = doc_stats.over_batch(pa.array(texts, pa.string()), lambda d, o: doc_stats.TextFacts(d, o).base())
    got = np.stack([np.concatenate([p[c] for p in parts]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], axis=1)
    assert got.tolist() == [list(base(t)) for t in texts]


def test_statistics_are_finite():
    import pyarrow as pa

    stats = np.concatenate(doc_stats.over_batch(pa.array(ODD, pa.string()), doc_stats.statistics))
    assert stats.shape == (len(ODD), len(doc_stats.STATISTICS)) and np.isfinite(stats).all()


def test_margins_equal_sparse_rows():
    import pyarrow as pa

    from chronofold.llm import textops

    data, offsets = textops.text_bytes(pa.array([t or "" for t in ODD]))
    weights = np.random.default_rng(0).normal(size=quality_rules.N_KINDS << quality_rules.BITS)
    f = doc_stats.TextFacts(data, offsets)
    whole = quality_rules.margins(f, weights)
    assert np.allclose(whole, [float(weights[s] @ x) for s, x in quality_rules.sparse_rows(f)])
    for i, t in enumerate(ODD):  # neighbours in a batch have no influence
        alone = doc_stats.TextFacts(*textops.text_bytes(pa.array([t or ""])))
        assert np.allclose(quality_rules.margins(alone, weights)[0], whole[i])


def judged(text, weights):
    """Everything that is measured of one text."""
    import pyarrow as pa

    from chronofold.llm import textops

    data, offsets = textops.text_bytes(pa.array([text]))
    f = doc_stats.TextFacts(data, offsets)
    base = {k: int(v[0]) for k, v in f.base().items()}
    return base, doc_stats.statistics(data, offsets)[0], quality_rules.margins(f, weights)[0], quality_rules.sparse_rows(f)[0], f.hashes


LONG = [
    "one",
    "x" * 300,
    " " * 300,
    "Wort Wort Wort\n" * 40,
    ("a b " * 50 + "z" * 90 + " \u00e9\u00df\u4e2d END! END! $# \n\n same line here\n same line here\n") * 3,
    "\u4e2d\u6587" * 200 + " tail",
]


@pytest.mark.parametrize("window", [1, 2, 3, 7, 64])
def test_long_texts_in_windows_equal_whole_ones(monkeypatch, window):
    from chronofold.llm import textops

    weights = np.random.default_rng(1).normal(size=quality_rules.N_KINDS << quality_rules.BITS)
    whole = [judged(t, weights) for t in LONG]
    monkeypatch.setattr(textops, "WINDOW", window)
    monkeypatch.setattr(doc_stats, "SORTED", 5)
    for text, (counts, stats, margin, (slots, values), hashes) in zip(LONG, whole, strict=True):
        again = judged(text, weights)
        assert again[0] == counts and (again[4] == hashes).all()
        assert np.allclose(again[1], stats) and np.isclose(again[2], margin)
        assert (again[3][0] == slots).all() and np.allclose(again[3][1], values)
        assert [again[0][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [int(x) for x in base(text)]


@pytest.mark.parametrize("kind", ["prose", "unbroken"])
def test_a_text_of_fifty_megabytes(kind):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    block = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(150_000)) if kind == "prose" else "".join(rng.choices("abc\u4e2d", k=700_000))
    text = block * (50_000_000 // len(block.encode()) + 1)
    column, size = pa.array([text]), len(text.encode())
    model = quality_rules.QualityModel(np.random.default_rng(2).normal(size=quality_rules.N_KINDS << quality_rules.BITS), 1.0, 0.0)
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    doc_stats.over_batch(pa.array(["warm up"]), doc_stats.statistics)
    tracemalloc.start()
    try:
        out = quality_rules._judged(batch, model)
        doc_stats.over_batch(column, doc_stats.statistics)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert size > 50_000_000 and peak < (16 if kind == "prose" else 5) * size, peak / size
    assert out["n_words"][0] == text.count(" ") + 1 and out["word_chars"][0] == len(text) - text.count(" ")


def test_rules_learn_and_filter(spark, tables):
    docs, labels = tables
    model = quality_rules.train(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_rules.judge_documents(docs, model).collect()
    assert len(rows) == len(truth) and np.mean([r["kept"] == (truth[r["doc_id"]] == 1) for r in rows]) > 0.97
    assert all(0 <= r["probability"] <= 1 for r in rows)
    kept = quality_rules.filter_documents(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_rules_without_labels_keep_by_the_base_only(spark, tables):
    docs, labels = tables
    for few in (labels.limit(0), labels.where("quality = 1")):
        model = quality_rules.train(docs, few)
        assert quality_rules.judge_documents(docs, model).where("kept = base_failed").count() == 0


def test_odd_rows(spark, tables):
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    model = quality_rules.train(*tables)
    rows = quality_rules.judge_documents(docs, model).collect()
    assert Counter(tuple(r[c] for c in quality_rules.COLUMNS[:5]) for r in rows) == Counter(base(t) for t in ODD)
    assert all(r["base_failed"] and not r["kept"] for r in rows)
    fourier = quality_classifier.train(*tables)
    scored = quality_classifier.score_documents(docs, fourier).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert quality_rules.judge_documents(docs.limit(0), model).count() == 0 and quality_classifier.score_documents(docs.limit(0), fourier).count() == 0


def test_classifier_on_held_out_rows(spark, tables):
    docs, labels = tables
    rows = quality_classifier.score_documents(docs, quality_classifier.train(docs, labels)).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_classifier_ignores_held_out_labels(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_classifier.train(docs, x) for x in (labels, turned))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.values, b.values)


def test_classifier_without_labels(spark, tables):
    docs, labels = tables
    assert quality_classifier.train(docs, labels.limit(0)).score(np.zeros((1, len(doc_stats.STATISTICS))))[0] == 0.5
    assert quality_classifier.train(docs, labels.where("quality = 0")).score(np.zeros((1, len(doc_stats.STATISTICS))))[0] == 0.0


def test_isotonic_rises():
    at, values = quality_classifier.isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and len(at) == len(values)


def test_isotonic_rises_where_counts_differ():
    """Against the fit by its definition: the largest of the least means over runs of smoothed bins."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = rng.integers(1, 1001, rng.integers(1, 12)).astype(float)
        good = np.floor(counts * rng.random(len(counts)))
        good[0], centres = 0, np.arange(float(len(counts)))
        at, values = quality_classifier.isotonic(centres, counts, good)
        n, g = counts + 2 * quality_classifier.SMOOTHING, good + quality_classifier.SMOOTHING
        mean = lambda a, b: g[a : b + 1].sum() / n[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]
        assert (np.diff(values) > 0).all() and np.allclose(np.unique(np.round(want, 12)), np.round(values, 12))
    at, values = quality_classifier.isotonic(np.arange(2.0), np.array([1.0, 1000.0]), np.array([0.0, 1.0]))
    assert (np.diff(values) >= 0).all()


def test_classifier_equals_a_direct_solve(spark, tables):
    """The query's scores, by one solve of the whole ridge system on the driver."""
    import pyarrow as pa

    docs, labels = tables
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    part = {r["doc_id"]: r["part"] for r in quality_rules.labelled_sample(labels, 10**6).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    ids = sorted(truth)
    stats = lambda some: np.concatenate(doc_stats.over_batch(pa.array([texts[i] for i in some]), doc_stats.statistics))
    x = stats(ids)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = quality_classifier.fourier((x - mean) / scale)
    fit = np.array([part[i] != 0 for i in ids])
    y = np.array([truth[i] for i in ids], float)
    penalty = quality_classifier.RIDGE * fit.sum() / quality_classifier.FEATURES * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(z[fit].T @ z[fit] + penalty, z[fit].T @ y[fit])
    bins = np.clip((z[~fit] @ weights + 0.5) / 2 * quality_classifier.BINS, 0, quality_classifier.BINS - 1).astype(int)
    used = np.unique(bins)
    knots, values = quality_classifier.isotonic(-0.5 + (used + 0.5) * 2 / quality_classifier.BINS, np.array([(bins == b).sum() for b in used], float), np.array([y[~fit][bins == b].sum() for b in used]))
    want = dict(zip(sorted(texts), np.interp(quality_classifier.fourier((stats(sorted(texts)) - mean) / scale) @ weights, knots, values), strict=True))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(docs, quality_classifier.train(docs, labels)).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_rules_fit_reaches_its_optimum(spark, tables):
    """The gradient of the objective vanishes, and a direct descent from there gains nothing."""
    import pyarrow as pa

    from chronofold.scratch import Scratch

    docs, labels = tables
    found = quality_rules.labelled_documents(docs, quality_rules.labelled_sample(labels, 120)).where("part <> 0").collect()
    rows = spark.createDataFrame([(r["text"], r["y"]) for r in found], "text string, y int").repartition(5)
    w, b = quality_rules._fit(quality_rules._vectors(rows, Scratch(spark)))
    sparse = [r for p in doc_stats.over_batch(pa.array([r["text"] for r in found]), lambda d, o: quality_rules.sparse_rows(doc_stats.TextFacts(d, o))) for r in p]
    used = np.unique(np.concatenate([i for i, _ in sparse]))
    x = np.zeros((len(sparse), len(used)))
    for k, (i, v) in enumerate(sparse):
        x[k, np.searchsorted(used, i)] = v
    y = np.array([r["y"] for r in found], float)
    deviation = x.std(axis=0, ddof=1)
    x, u = x / np.where(deviation > 0, deviation, 1), w[used] * deviation
    assert not w[np.setdiff1d(np.arange(len(w)), used)].any()

    def loss(u, b):
        m = x @ u + b
        return np.mean(np.logaddexp(0, m) - y * m) + quality_rules.L2 / 2 * u @ u

    def slope(u, b):
        miss = (1 / (1 + np.exp(-(x @ u + b))) - y) / len(y)
        return np.append(x.T @ miss + quality_rules.L2 * u, miss.sum())

    best, step = (u.copy(), b), 1.0 / (np.linalg.norm(x, 2) ** 2 / 4 / len(y) + 1)
    for _ in range(3000):
        g = slope(*best)
        best = best[0] - step * g[:-1], best[1] - step * g[-1]
    assert loss(u, b) - loss(*best) < 1e-3 * loss(*best) and np.abs(slope(u, b)).max() < 1e-2


def test_repeated_labelled_rows_are_learned_from_once(spark, tables):
    docs, labels = tables
    more = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 0").withColumn("text", F.lit("zzz " * 80)))
    sample = quality_rules.labelled_sample(labels, 50)
    rows = quality_rules.labelled_documents(more, sample).collect()
    assert len(rows) == 50 == len({r["doc_id"] for r in rows})


def test_rules_on_rows_that_were_not_learned_from(spark, tables):
    docs, labels = tables
    model = quality_rules.train(docs, labels, keep=~quality_classifier.held_out(F.col("doc_id")))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality_rules.judge_documents(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["kept"] == (truth[r["doc_id"]] == 1) for r in rows if not r["base_failed"]]) > 0.97


M64, RADIX = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_slots(text):
    """The n-grams of a text, counted by kind and slot, one by one."""
    data = (text or "").encode()
    words = [w.encode() for w in WORD.findall(text or "")]
    top = lambda h, kind: (h >> (64 - quality_rules.BITS)) + (kind << quality_rules.BITS)
    kinds = []
    for kind, k in enumerate(quality_rules.CHAR_GRAMS):
        hashes = [(int.from_bytes(data[i : i + k], "little") * RADIX) & M64 for i in range(len(data) - k + 1)]
        kinds.append(Counter(top(h ^ ((h << 29) & M64), kind) for h in hashes))
    names = [mixed((sum((b + 1) * pow(RADIX, j, 1 << 64) for j, b in enumerate(w)) + len(w)) & M64) for w in words]
    kinds.append(Counter(top(h, len(kinds)) for h in names))
    is_mark = lambda b: bool(doc_stats.PUNCTUATION[b])
    looks = []
    for i, w in enumerate(words):
        upper = sum(65 <= b <= 90 for b in w)
        case = 0 if upper == 0 else (2 if upper >= max(2, len(w) // 2) else 1)
        again = i > 0 and words[i - 1] == w
        looks.append(mixed((((case * 128 + (w[-1] if is_mark(w[-1]) else 0)) * 2 + is_mark(w[0])) * 2 + again) * 8 + min(len(w) // 3, 7)))
    for tokens in (names, looks):
        kinds.append(Counter(top(mixed((a * RADIX + b) & M64), len(kinds)) for a, b in zip(tokens, tokens[1:])))
    return kinds


def plain_margin(text, weights):
    return sum(quality_rules.SCALE * sum(weights[s] * n for s, n in c.items()) / max(1, sum(c.values())) for c in plain_slots(text))


def plain_platt(margin, y):
    """Slope and intercept that minimise the log loss against smoothed targets, by steps that never go uphill, until the gradient is zero."""
    n1, n0 = sum(y), len(y) - sum(y)
    target = [(n1 + 1) / (n1 + 2) if v else 1 / (n0 + 2) for v in y]

    def loss(a, b):
        z = [a * m + b for m in margin]
        return sum(max(v, 0) - t * v + math.log1p(math.exp(-abs(v))) for v, t in zip(z, target)) + 5e-4 * ((a - 1) ** 2 + b**2)

    a, b = 1.0, 0.0
    for _ in range(200):
        p = [1 / (1 + math.exp(-max(-700, min(700, a * m + b)))) for m in margin]
        da = sum((q - t) * m for q, t, m in zip(p, target, margin)) + 1e-3 * (a - 1)
        db = sum(q - t for q, t in zip(p, target)) + 1e-3 * b
        aa = sum(q * (1 - q) * m * m for q, m in zip(p, margin)) + 1e-3
        ab = sum(q * (1 - q) * m for q, m in zip(p, margin))
        bb = sum(q * (1 - q) for q in p) + 1e-3
        va, vb = (bb * da - ab * db) / (aa * bb - ab * ab), (aa * db - ab * da) / (aa * bb - ab * ab)
        share = 1.0
        while share > 1e-9 and loss(a - share * va, b - share * vb) > loss(a, b):  # never uphill
            share /= 2
        a, b = a - share * va, b - share * vb
    assert abs(da) + abs(db) < 1e-6
    return a, b


def test_verdict_against_plain_python(spark, tables):
    docs, labels = tables
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" Ende!! END \u00e9\u00df Wort Wort"))).otherwise(F.col("text")))
    model = quality_rules.train(docs, labels)
    found = quality_rules.labelled_documents(docs, quality_rules.labelled_sample(labels, quality_rules.MAX_LABELLED))
    held = found.where("part = 0").collect()
    _, shift = quality_rules._fit(quality_rules._vectors(found.where("part <> 0"), Scratch(spark)))
    slope, intercept = plain_platt([plain_margin(r["text"], model.weights) + shift for r in held], [r["y"] for r in held])
    assert model.slope == pytest.approx(slope, rel=1e-3) and model.intercept == pytest.approx(intercept + slope * shift, rel=1e-3, abs=1e-3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {-1 - i: t for i, t in enumerate(ODD)}
    asked = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    rows = quality_rules.judge_documents(asked, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        z = max(-50, min(50, model.slope * plain_margin(texts[r["doc_id"]], model.weights) + model.intercept))
        probability = 1 / (1 + math.exp(-z))
        n_words, *_, repeated = base(texts[r["doc_id"]])
        failed = n_words < 50 or 100 * repeated > 50 * n_words
        assert r["probability"] == pytest.approx(probability, rel=1e-6, abs=1e-12)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and probability >= 0.5)
    assert 0 < sum(r["kept"] for r in rows) < len(rows)
