import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronofold.llm import unigram

MODEL = unigram.model(unigram.default_path())
SCORE = {t: s for t, s, ok in zip(MODEL.pieces.texts, MODEL.pieces.scores, MODEL.pieces.usable, strict=True) if ok}
ID = {t: i for i, (t, ok) in enumerate(zip(MODEL.pieces.texts, MODEL.pieces.usable, strict=True)) if ok}
LONGEST = max(map(len, SCORE))


def viterbi(text, scores=SCORE, unknown=MODEL.unknown):
    """Ids by a plain search over the whole text."""
    if not text:
        return []
    text = unigram.MARK + text.replace(" ", unigram.MARK)
    best = [(0.0, None, None)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - LONGEST), end):
            piece = text[start:end]
            if piece in scores:
                score = best[start][0] + scores[piece]
            elif end - start == 1:
                score = best[start][0] + unknown
            else:
                continue
            if best[end] is None or score > best[end][0]:
                best[end] = (score, start, ID.get(piece))
    ids, end = [], len(text)
    while end:
        _, start, piece = best[end]
        ids = ([piece] if piece is not None else MODEL.pieces.bytes_at[list(text[start:end].encode())].tolist()) + ids
        end = start
    return ids


def encode(text):
    return np.frombuffer(MODEL.encode_batch([text])[0], "<i4").tolist()


WORDS = st.lists(st.sampled_from(["the", "and", "thing", " ", "  ", "▁", "é", "日本", "🙂", "\n", "①", "ing", "Queue", "0x1f", "."]), max_size=12).map("".join)


@given(st.one_of(st.text(max_size=40), WORDS))
@settings(max_examples=250, deadline=None)
def test_best_path_and_round_trip(text):
    ids = encode(text)
    assert ids == viterbi(text)
    assert MODEL.decode(np.array(ids, np.int64)) == text.replace(unigram.MARK, " ")


def test_trie_finds_every_piece():
    words = [(b"a", 0), (b"ab", 1), (b"abc", 2), (b"b", 3), (b"\xff\x00", 4)]
    trie = unigram.DoubleArrayTrie(words)
    data = np.frombuffer(b"abcab\xff\x00", np.uint8)
    who, end, piece = trie.matches(data, np.arange(len(data)), np.full(len(data), len(data)))
    want = sorted((i, i + len(w), p) for w, p in words for i in range(len(data)) if data[i : i + len(w)].tobytes() == w)
    assert sorted(zip(who.tolist(), end.tolist(), piece.tolist(), strict=True)) == want


def test_invalid_ids():
    for bad in ([1], [-1], [10**6]):
        with pytest.raises(ValueError):
            MODEL.decode(np.array(bad))


def test_documents(spark):
    texts = [None, "", "  a the ", "x" * 20_000, "ünïcode ☃ " * 500, "same", "same"]
    df = spark.createDataFrame([(None if i == 2 else i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = unigram.decode_documents(unigram.encode_documents(df)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, unigram.round_trip(df).collect()))
    got = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        r = got[None if i == 2 else i]
        assert r["text"] == (t or "") and r["n_ids"] == len(r["ids"]) // 4
        assert len(t or "") > 6000 or np.frombuffer(r["ids"], "<i4").tolist() == viterbi(t)
    assert got[4]["n_byte_ids"] == 0 or got[4]["n_byte_ids"] % 500 == 0
    assert unigram.encode_documents(df.limit(0)).count() == 0


def segmentations(text):
    """All ways to cut a unit into pieces; a character that none covers may stand bare."""
    if not text:
        yield []
    for end in range(1, min(len(text), LONGEST) + 1):
        piece = text[:end] if text[:end] in SCORE else None
        if piece is not None or end == 1:
            for rest in segmentations(text[end:]):
                yield [piece, *rest]


def plain_em(counts, steps):
    score = {t: -math.log(len(SCORE)) for t in SCORE}
    for _ in range(steps):
        uses, unknown, seen = dict.fromkeys(SCORE, unigram.EM_SMOOTHING), min(score.values()) - unigram.UNKNOWN_PENALTY, 0.0
        for unit, n in counts.items():
            ways = [(math.exp(sum(unknown if p is None else score[p] for p in way)), way) for way in segmentations(unit)]
            whole = sum(w for w, _ in ways)
            seen += n * math.log(whole)
            for w, way in ways:
                for p in way:
                    if p is not None:
                        uses[p] += n * w / whole
        total = sum(uses.values())
        score = {t: math.log(u / total) for t, u in uses.items()}
    return score, seen


EM_TEXTS = ["the cat and the other thing", "the  end", "日本 é\u0378x", None, "", "the cat", "nothing other"]


def test_scores_by_plain_em(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EM_TEXTS)], "id int, text string").repartition(3)
    counts = Counter(u for t in EM_TEXTS for u in unigram.units_of(t or ""))
    assert {r["unit"]: r["n"] for r in unigram.unit_counts(df).collect()} == counts
    for steps in (1, 3):
        want, seen = plain_em(counts, steps)
        got = unigram.estimate_scores(df, steps=steps).collect()
        assert max(abs(r["score"] - want[r["piece"]]) for r in got if MODEL.pieces.usable[r["id"]]) < 1e-5
        assert abs(got[0]["log_likelihood"] - seen) < 1e-3 * abs(seen)


def test_likelihood_rises_and_long_units_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    seen = [unigram.estimate_scores(docs, steps=n).first()["log_likelihood"] for n in (1, 2, 4)]
    assert seen[0] < seen[1] < seen[2]
    rng = np.random.default_rng(0)
    units = ["".join(rng.choice(list("thingande日é"), n)) for n in (3, 40, 200, 255)]
    uses, likelihood = MODEL.expected_uses(units, np.arange(1.0, 5.0))
    parts = [MODEL._sums_long(MODEL._lattice([u.encode()])) for u in units]
    assert np.isclose(likelihood, sum(n * w[0] for n, (_, _, w) in zip(range(1, 5), parts, strict=True)))
    assert MODEL._solve_together([u.encode() for u in units]) == [MODEL._solve_long(u.encode()) for u in units]
    assert np.isclose((uses * np.array([len(t) for t in MODEL.pieces.texts])).sum(), sum(n * len(u) for n, u in zip(range(1, 5), units, strict=True)))


def test_estimated_scores_encode_by_plain_viterbi(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EM_TEXTS)], "doc_id long, text string")
    scores = unigram.estimate_scores(df, steps=2)
    fitted = unigram.model(unigram.default_path(), unigram._array(scores))
    own = {t: s for t, s, ok in zip(fitted.pieces.texts, fitted.pieces.scores, fitted.pieces.usable, strict=True) if ok}
    for r in unigram.round_trip(df, scores=scores).collect():
        text = EM_TEXTS[r["doc_id"]] or ""
        assert r["text"] == text and np.frombuffer(r["ids"], "<i4").tolist() == viterbi(text, own, fitted.unknown)


def test_units_of_a_column_are_those_of_each_text():
    """Cut, encoded and decoded on the bytes of a whole column, slices of it and nulls included."""
    texts = [None, "", " ", "  ", "a", " a", "a ", "▁", "a▁", "▁▁a b", "x▁ y", "é 日本 ▁", "▀ ▂", "", "b  c", "\x00 \n\t", "long" * 40 + " a", "a"]
    for some in (pa.array(texts), pa.array(texts).slice(3, 9), pa.array(texts[:2], pa.string()), pa.array([], pa.string()), pa.array(["▁", "▁"])):
        units, first = unigram.split_units(some)
        units = units.to_pylist()
        assert [units[lo:hi] for lo, hi in zip(first[:-1], first[1:], strict=True)] == [unigram.units_of(t or "") for t in some.to_pylist()]
        coded = MODEL.encode_column(some).to_pylist()
        assert coded == [b"".join(MODEL.solve(unigram.units_of(t or ""))) for t in some.to_pylist()]
        ids, bounds = unigram._flat_ids(pa.array(coded, pa.binary()))
        assert MODEL.decode_parts(ids, bounds) == [(t or "").replace("▁", " ") for t in some.to_pylist()]


def test_one_unit_of_a_megabyte(spark):
    text = "ab日x" * 160_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = unigram.round_trip(df).first()
    assert r["text"] == text and r["n_ids"] == len(r["ids"]) // 4


def test_many_distinct_units_without_spaces_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(unigram, "COUNTED_CHARS", 20_000)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdeé日"), 300)) + str(i) for i in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts + texts[:50] + ["a b a", None]], "text string").coalesce(1)
    rows = df.select("text").mapInArrow(lambda b: b, "text string")
    assert {r["unit"]: r["n"] for r in unigram.unit_counts(rows).collect()} == Counter(u for t in [*texts, *texts[:50], "a b a"] for u in unigram.units_of(t))
    scores = unigram.estimate_scores(df, steps=1)
    assert scores.count() == len(MODEL.pieces.texts)


LOGS = unigram.UnigramModel(replace(MODEL.pieces, scores=np.where(MODEL.pieces.usable, -6 - 8 * np.random.default_rng(0).random(len(MODEL.pieces.texts)), 0.0)), MODEL.trie)  # log probabilities, unlike the file's ranks


def test_sums_of_probabilities_equal_sums_of_logarithms():
    rng = np.random.default_rng(2)
    units = ["".join(rng.choice(list("thingande日é\u0378"), n)) for n in range(1, 21)] * 3 + ["x" * 63, "\u0378" * 31, "the"]
    counts = rng.integers(1, 9, len(units)).astype(float)
    x = LOGS._lattice([u.encode() for u in units])
    before, after, whole = LOGS._sums_together(x)
    weight = np.exp(before + x.gain + after - whole[x.owner]) * counts[x.owner]
    plain = np.bincount(x.piece[x.piece >= 0], weight[x.piece >= 0], len(MODEL.pieces.texts))
    uses, likelihood, left = LOGS._linear_uses(x, counts)
    assert len(left) == 0 and np.allclose(uses, plain, rtol=1e-9) and np.isclose(likelihood, whole @ counts, rtol=1e-12)
    assert np.allclose(LOGS.expected_uses(units, counts)[0], plain, rtol=1e-9)


def test_sums_that_leave_the_range_of_doubles_go_by_logarithms(monkeypatch):
    units = ["thing", "the", "\u0378" * 20, "nothing", "x" * 50]
    counts = np.arange(1.0, 6.0)
    plain = LOGS.expected_uses(units, counts)
    monkeypatch.setattr(unigram, "LEAST_SUM", 1e-3)
    monkeypatch.setattr(unigram, "MOST_SUM", 1e3)
    left = LOGS._linear_uses(LOGS._lattice([u.encode() for u in units]), counts)[2]
    again = LOGS.expected_uses(units, counts)
    assert 0 < len(left) and np.allclose(plain[0], again[0]) and np.isclose(plain[1], again[1])
