import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import topk


def brute(rows, k=5, step=50):
    q = {}
    for i, (v, e) in enumerate(rows):
        if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            q[i] = (v, [math.floor(256 * x) for x in e])
    out = []
    for v, e in q.values():
        if v % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, f)), w) for w, f in q.values() if w != v)[:k]
            out += [(v, i + 1, w, -s) for i, (s, w) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k=5, step=50, **options):
    df = spark.createDataFrame([("clash", v, e, 1) for v, e in rows], "score string, vec_id long, embedding array<float>, weights int").repartition(3)
    vectors = topk.quantised(df)
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.where(F.col("vec_id") % step == 0), k, **options).collect())


def vectors(n, d=16, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32) / 4
    x[:copies] = x[0]
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_against_brute_force_over_many_shards(spark):
    rows = vectors(1500, copies=500)
    assert run(spark, rows, shard=200, group=7) == brute(rows)


def test_one_shard_with_more_blocks_than_needed(spark):
    rows = vectors(2500, d=4, seed=3)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 0.0]), (None, [1.0, 1.0]), (4, [0.5, 0.25]), (4, [0.5, 0.25]), (5, [0.5]), (6, []), (7, [-1.0, -1.0]), (100, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_few_candidates_and_empty_tables(spark):
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []
    assert run(spark, [(0, [1.0]), (1, [0.5])]) == [(0, 1, 1, 128 * 256)]


def test_huge_components_are_exact(spark):
    rows = [(i, [60000.0 + i] * 64) for i in range(12)]
    assert run(spark, rows) == brute(rows)


def plain(ids, weights, queries, query_ids, k):
    out = []
    for q, x in zip(query_ids, queries, strict=True):
        scored = sorted((-int(x @ w), int(i)) for i, w in zip(ids, weights, strict=True) if i != q)[:k]
        out += [(int(q), i, -s) for s, i in scored]
    return sorted(out)


def test_search_prunes_blocks_of_near_vectors_and_stays_exact():
    rng = np.random.default_rng(1)
    weights = np.concatenate([rng.normal(size=(256, 8)) * 4 + 400 * np.eye(8)[i] for i in range(8)]).round()
    shuffled = rng.permutation(len(weights))
    shard = topk._Shard(shuffled, weights)
    asked = np.arange(0, len(weights), 40)
    row, ids, scores = shard.search(shuffled[asked], weights[asked], 5)
    got = sorted(zip(shuffled[asked][row].tolist(), ids.tolist(), scores.tolist(), strict=True))
    assert got == plain(shuffled, weights, weights[asked], shuffled[asked], 5)
    assert shard.scored <= len(asked) * (len(shard.cuts) - 1) / 6  # seven of eight directions are never scored


def test_search_scores_all_blocks_where_bounds_are_loose():
    rng = np.random.default_rng(2)
    weights = np.floor(rng.normal(size=(1000, 16)) * 60)
    shard = topk._Shard(np.arange(1000), weights)
    row, ids, scores = shard.search(np.arange(0, 1000, 50), weights[::50], 5)
    assert sorted(zip((row * 50).tolist(), ids.tolist(), scores.tolist(), strict=True)) == plain(range(1000), weights, weights[::50], range(0, 1000, 50), 5)
    assert shard.scored <= 20 * (len(shard.cuts) - 1)


def test_shards_below_the_kth_score_are_not_asked(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4) * 0.01 + np.eye(4)[i % 4]]) for i in range(800)]
    assert run(spark, rows, shard=100) == brute(rows)
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    placed = topk._placed(vectors, 8, 100).persist()
    extents = topk._extents(placed)
    assert {r["shard"]: (r["high"], r["low"]) for r in extents.collect()} == {s: (np.maximum(np.max(w, axis=0), 0).tolist(), np.minimum(np.min(w, axis=0), 0).tolist()) for s, w in by_shard(placed).items()}
    n = extents.count()
    asked = vectors.where("vec_id = 0").selectExpr("1L AS query_key", "vec_id AS query_id", "weights AS query", "60000L AS least")
    assert topk._routed(asked, extents, n, 1, True).count() == 1 and topk._routed(asked, extents, n, 1, False).count() < n / 2


def by_shard(placed):
    out = {}
    for r in placed.collect():
        out.setdefault(r["shard"], []).append(r["weights"])
    return out


def test_repeated_queries(spark):
    rows = vectors(60) + [(50, vectors(60)[50][1]), (0, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    got = [tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect()]
    assert sorted(r for r in got if r[0] == 50) == sorted(r for r in brute(rows[:-2] + rows[-1:]) if r[0] == 50)
    assert sorted(r[1] for r in got if r[0] == 0) == sorted(2 * [1, 2, 3, 4, 5])  # two vectors under one id: each is answered


def test_components_beyond_a_doubles_whole_numbers(spark):
    rows = [(i, [70000.0 + 1024 * i, 1.0]) for i in range(12)] + [(50, [-90000.0, 3.0]), (100, [2.0**20, -(2.0**22)])]
    assert run(spark, rows) == brute(rows)


def test_scores_near_the_end_of_a_long_and_beyond(spark):
    rows = [(0, [2.0**23, 2.0**23]), (1, [2.0**23, -(2.0**23)]), (2, [2.0**22, 2.0**22]), (3, [2.0**23, 2.0**22])]
    assert run(spark, rows) == brute(rows)
    for more in ([(4, [2.0**23, 2.0**23])], [(4, [2.0**60, 0.0])]):
        with pytest.raises(Exception, match="exceeds a long"):
            run(spark, rows + more)


def test_shards_and_groups_are_bounded_by_bytes(spark, monkeypatch):
    rows = vectors(900, d=40, seed=8)
    plain = brute(rows)
    seen = []
    real = topk._placed
    monkeypatch.setattr(topk, "_placed", lambda candidates, shards, shard: seen.append((shards, shard)) or real(candidates, shards, shard))
    monkeypatch.setattr(topk, "SHARD_BYTES", 8 * 40 * 200)
    monkeypatch.setattr(topk, "GROUP_BYTES", 8 * 40 * 3)
    monkeypatch.setattr(topk, "CELL_BYTES", 16 * 40 * 2)
    assert run(spark, rows) == plain and seen == [(5, 200)]
