import random
import re
from collections import Counter

import numpy as np

from chronofold.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], least[root(i)] == d) for i, (d, _) in enumerate(rows))


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def corpus(seed=0, star=250):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = [" ".join(text(rng.randint(5, 200))) for _ in range(150)]
    for _ in range(25):
        own = text(rng.randint(60, 200))
        rows += [changed(rng, own, rng.randint(0, 3)) for _ in range(rng.randint(2, 6))]
    hub = text(146)
    rows += [changed(rng, hub, rng.randint(0, 12)) for _ in range(star)]
    rows += [" ".join(hub).upper()] * 40
    passage = text(60)
    rows += [" ".join(text(40) + passage + text(40)) for _ in range(60)]
    rows += [None, "", " \n", "one", "ONE", "one two three four", "one two three four", "é è", "É è"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def run(spark, rows, parts=5):
    df = spark.createDataFrame([("x", d, t, 0) for d, t in rows], "id string, doc_id long, text string, component int").repartition(parts)
    return sorted(tuple(r) for r in neardup.near_duplicates(df).collect())


def test_components_against_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_large_regions_are_parted_and_lose_no_component(spark):
    """A limit that reaches the workers, so that nearly every region is parted."""
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, region=16).collect()) == brute(rows)


def test_small_tables_are_not_dealt_into_a_file_a_partition(spark, monkeypatch):
    """Light tables stand in few files, however many partitions a shuffle has."""
    from chronofold.scratch import Scratch

    files, plain = {}, Scratch.save

    def save(self, df, name, *rest, **named):
        out = plain(self, df, name, *rest, **named)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(Scratch, "save", save)
    rows, held = corpus(4), {"spark.sql.shuffle.partitions": "120", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert run(spark, rows) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most = max(120 // 8, 2 * spark.sparkContext.defaultParallelism)
    assert all(files[name] <= most for name in ("classes", "pairs", "links", "edges")), files


def test_regions_too_large_for_a_task_lose_no_component(spark):
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, region_bytes=1).collect()) == brute(rows)


def test_texts_under_one_id_have_components_of_their_own(spark):
    rows = [(2, "a b c d e f"), (2, "quite another text under this id"), (5, "Quite another text under this id"), (1, "A b c d e f"), (7, "its own words"), (7, "its own words"), (9, None), (9, "words after none"), (None, "a b c d e f"), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == Counter([(2, 1, False), (2, 2, True), (5, 2, False), (1, 1, True), (7, 7, True), (7, 7, True), (9, 9, True), (9, 9, True), (None, 1, False), (None, None, True), (None, None, True)])


def test_of_equal_rows_the_same_one_stays(spark):
    rows = [(1, "some text", i, {"k": i}) for i in range(20)] + [(2, "other text", 7, {"k": 7})]
    schema = "doc_id long, text string, n int, m map<string, int>"
    kept = {tuple(sorted((r["doc_id"], r["n"]) for r in neardup.keep_one(spark.createDataFrame(some, schema).repartition(p)).collect())) for some in (rows, rows[::-1]) for p in (1, 3)}
    assert len(kept) == 1 and len(kept.pop()) == 2


def test_components_of_a_long_path(spark):
    from chronofold.scratch import Scratch

    ids = list(range(1, 120))
    random.Random(1).shuffle(ids)
    edges = [(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])] + [(500, 501), (501, 502)]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 1 for i in range(1, 120)} | {500: 500, 501: 500, 502: 500}


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (None, "alone here"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, False), (4, 2, False), (2, 2, True), (2, 2, True), (None, None, True), (9, 9, True)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.keep_one(df)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 2, 9] and kept.columns == df.columns


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    rows = np.array([3, 7, 29])
    assert neardup._shared(sets, rows, width=64).tolist() == [[len(np.intersect1d(sets[r], s)) for s in sets] for r in rows]


def test_parts_of_a_region_cover_it():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 3, (9000, neardup.DEPTH)).astype(">u2").view(f"S{2 * neardup.DEPTH}").ravel()).view(">u2").reshape(-1, neardup.DEPTH)
    parts = list(neardup._part(keys, 0, len(keys), 0))
    assert all(b - a <= neardup.REGION for a, b in parts) and sum(b - a for a, b in parts) > 8900


def boilerplate_family(seed=0):
    """Texts of a common passage and an own ending: any two stay under the limit but the pairs, which share a bit more and whose ids lie far apart."""
    rng = random.Random(seed)
    passage = [f"w{rng.randrange(5000)}" for _ in range(104)]
    ends = [[f"e{i}x{j}" for j in range(11)] for i in range(300)]
    texts = [passage + e for e in ends] + [passage + e[:3] + [f"o{w}" for w in e[3:]] for e in ends[:60]]
    return [(i + 1, " ".join(t)) for i, t in enumerate(texts)]


def test_divided_runs_lose_no_component(spark, monkeypatch):
    rows = boilerplate_family()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda limit: sorted(tuple(r) for r in neardup.near_duplicates(df, limit).collect())
    assert found(2) == brute(rows)
    monkeypatch.setattr(neardup, "_join_divided", lambda members, classes, sets, links, joined, scratch, limit: joined)
    assert found(2) != brute(rows)


def test_components_with_every_run_divided(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, 3).collect()) == brute(rows)


def test_runs_across_range_bounds_are_whole(spark):
    options = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    classes = spark.createDataFrame([(i, bytes(2 * neardup.HASHES)) for i in range(4)], "id long, signature binary")
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        members = neardup.regions(neardup.forest(classes)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    ids, parts = {}, {}
    for r in members:
        ids.setdefault(r["run"], []).append(r["id"])
        parts.setdefault(r["run"], set()).add(r["region"])
    assert len(ids) == neardup.TREES and all(sorted(x) == [0, 1, 2, 3] for x in ids.values())
    assert max(map(len, parts.values())) > 1 and all(r["divided"] for r in members if len(parts[r["run"]]) > 1)


def test_texts_under_one_id_are_judged_each_by_itself(spark):
    rows = [(2, "a b c d e f"), (2, "quite another text under this id"), (5, "Quite another text under this id"), (1, "A b c d e f"), (7, "its own words"), (7, "its own words"), (9, None), (9, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in neardup.keep_one(df).collect()), key=str) == sorted([(2, rows[1][1]), rows[3], rows[4], (9, None), (None, "x")], key=str)


def test_an_empty_and_a_full_text_under_one_id_in_any_order(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, None), (2, changed(rng, words, 1)), (3, "other words that stand by themselves here")]
    for order in (rows, rows[::-1], [rows[2], rows[1], rows[3], rows[0]], [rows[0], (2, " \n"), *rows[2:]]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == brute(rows)
        assert sorted((r["doc_id"], (r["text"] or "").strip()) for r in neardup.keep_one(df).collect()) == [rows[0], (2, ""), rows[3]]
