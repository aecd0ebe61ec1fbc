import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import negatives


def brute(rows, step=100, k=5, m=10):
    good = [(v, y, [math.floor(256 * x) for x in e]) for v, y, e in rows if None not in (v, y, e) and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for v, y, e in {(v, y, tuple(e)) for v, y, e in good if v % step == 0}:
        scored = sorted((-dot(e, f), w, z) for w, z, f in good)
        for p, w, _ in [s for s in scored if s[2] == y and s[1] != v][:k]:
            fits = [(s, n) for s, n, z in scored if z != y and 30 * -p <= 100 * -s <= 90 * -p][:m]
            out += [(v, w, i + 1, n, -p, -s) for i, (s, n) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, step=100, parts=3):
    df = spark.createDataFrame([("clash", *r, 1.0) for r in rows], "score string, vec_id long, label int, embedding array<double>, cell double").repartition(parts)
    own = negatives.prepared(df)
    return sorted(tuple(r) for r in negatives.hard_negatives(own, own.where(F.col("vec_id") % step == 0)).collect())


def vectors(n, d=8, labels=4, seed=0, spread=1.0, centres=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    x = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))
    return [(i, int(y), [float(v) for v in row]) for i, (y, row) in enumerate(zip(rng.integers(0, labels, n), x, strict=True))]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"ROWS_A_PIVOT": 20, "GROUP": 7, "TASK_ROWS": 200, "ROWS_AN_ANCHOR": 4, "BLOCK_SCORES": 64}.items():
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("options", [{}, {"spread": 0.05}, {"d": 2, "spread": 0.3, "labels": 2}, {"labels": 40}])
def test_against_brute_force_over_many_groups(spark, small, options):
    rows = vectors(700, seed=3, **options)
    assert run(spark, rows, 10) == brute(rows, 10) != []


def test_one_group(spark):
    rows = vectors(400, seed=5)
    assert run(spark, rows, 25) == brute(rows, 25)


def test_a_third_of_the_rows_alike(spark, small):
    rows = vectors(400, seed=7)
    rows = [(v, y, rows[0][2]) if v % 3 == 0 else (v, y, e) for v, y, e in rows]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_odd_rows(spark):
    good = vectors(60, d=2, labels=2, seed=1)
    odd = [(0, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (200, 1, None), (300, 1, [None, 1.0]), (400, 0, [float("nan"), 1.0]), (500, 0, [float("inf"), 1.0]), (600, 1, []), (700, 0, [0.5]), (800, 1, [0.0, 0.0]), (900, 7, [3.0, 1.0])]
    twice = [good[0], good[0], good[1], good[1], (good[2][0], 0, good[2][2]), (100, 0, [1.0, 0.5]), (100, 1, [1.0, 0.5]), (100, 0, [0.25, -1.0])]
    rows = good + odd + twice
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(0, 1, [1.0])]) == [] and run(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    rows = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [0.95]), (4, 2, [0.3]), (5, 1, [-1.0]), (6, 2, [-0.5]), (7, 1, [0.0]), (8, 3, [0.0])]
    assert run(spark, rows) == brute(rows)
    assert [r[1:4] for r in brute(rows)] == [(1, 1, 2), (7, 1, 8)]


def test_huge_components_are_exact(spark):
    rows = [(i * 10, i % 2, [60000.0 * (1 - i / 40) + i] * 64) for i in range(22)]
    assert run(spark, rows) == brute(rows)
    rows = [(i * 10, i % 2, [3.9e6 * (1 - i / 40) + i] * 9) for i in range(22)]
    assert run(spark, rows) == brute(rows)


def test_rows_reach_only_groups_that_they_may_serve(spark, small):
    """Rows in narrow clusters, one label each: some copies are saved (a fifth; anchors lie far from all rows in the augmented space, so bounds are loose)."""
    rng = np.random.default_rng(0)
    middle = 4 * rng.normal(size=(30, 6))
    rows = spark.createDataFrame([(i, i % 30, [int(256 * v) for v in middle[i % 30] + 0.001 * rng.normal(size=6)]) for i in range(1500)], "vec_id long, label long, weights array<long>")
    space, n = negatives._space(rows)
    placed = negatives._placed(rows, space, False).cache()
    asked = negatives._placed(rows.where("vec_id % 4 = 0"), space, True).withColumn("row", F.col("vec_id"))
    counts, radius = negatives._cells(asked, space, [F.count("*"), F.max("dist")])
    limits = negatives._limits(asked, placed, space, radius, 5)
    cells = np.flatnonzero(counts)
    apart = space.apart[[r["cell"] for r in placed.select("cell").collect()]][:, cells]
    dist = np.array([r["dist"] for r in placed.select("dist").collect()])[:, None]
    serves = np.maximum(apart - radius[cells] - dist, dist - apart - radius[cells]) <= limits[cells] + space.slack
    placed.unpersist()
    assert 0 < serves.mean() < 0.85
