import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold import PanelInSampleSplit, PanelOutOfSampleSplit, TSInSampleSplit, TSOutOfSampleSplit
from chronofold.functions import models, prefix, regression


def panel(spark, seed=0):
    rng = random.Random(seed)
    rows = [(e, t, rng.random() if rng.random() > 0.1 else None, rng.choice([0.0, 1.0, 2.5]), float(t)) for e, n in (("A", 40), ("B", 25), ("C", 9)) for t in range(n)]
    return spark.createDataFrame(rows, "e string, t int, y double, x double, z double").repartition(3)


@pytest.mark.parametrize("block", [None, 7])
def test_fold_sums_equal_sums_of_rows(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(prefix, "SERIES_IN_ONE_TASK", 5)
        monkeypatch.setattr(prefix, "ROWS_A_BLOCK", block)
    measures = {"total": F.col("y"), "both": F.col("x") * F.col("y"), "known": F.when(F.col("y").isNotNull(), 1)}
    for splitter, df, entity in ((PanelOutOfSampleSplit(4, test_size=3, gap=1, max_train_size=8, missing="skip"), panel(spark), "e"), (PanelInSampleSplit(test_indices=[2, 6], max_train_size=3, missing="skip"), panel(spark), "e"), (TSOutOfSampleSplit(3, gap=2), panel(spark).where("e = 'A'").drop("e"), None), (TSInSampleSplit(test_indices=[3, 9, 11]), panel(spark).where("e = 'A'").drop("e"), None)):
        source = splitter.source(df, "t", entity)
        for role in ("train", "test"):
            for pooled in (False, True):
                by = ["fold_id", *([entity] if entity and not pooled else [])]
                rows = splitter.assign_rows(source, role=role).groupBy(*by).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in measures.items()))
                got = {tuple(r[c] for c in by): r for r in prefix.fold_sums(splitter, source, measures, role, pooled).collect()}
                expected = {tuple(r[c] for c in by): r for r in rows.collect()}
                assert got.keys() == expected.keys()
                for k, r in expected.items():
                    assert got[k]["n"] == r["n"] and all(got[k][c] == pytest.approx(r[c], abs=1e-9) for c in measures)


def test_a_model_by_sums_copies_no_train_rows(spark):
    splitter = PanelOutOfSampleSplit(4, test_size=3, missing="skip")
    source = splitter.source(panel(spark), "t", "e")
    by_sums = models.ratio_by_sums(splitter, source, "y", "x")
    assigned = splitter.assign(source)
    by_rows = models.ratio_model(panel(spark), assigned, ["e", "t"], "y", "x", ["e"])
    key = lambda df: {(r["fold_id"], r["e"], r["t"]): r["prediction"] for r in df.collect()}
    got, expected = key(by_sums), key(by_rows)
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v, rel=1e-12) for k, v in expected.items())
    assert "train" not in by_sums._jdf.queryExecution().optimizedPlan().toString().replace("train_lo", "").replace("train_hi", "")


def number(values):
    return [float("nan") if v is None else v for v in values]


def line_of(rows, xs):
    """Coefficients as defined: regressors in order, one that those before it explain stays out; and the intercept."""
    rows = [r for r in rows if None not in (r["y"], *(r[x] for x in xs))]
    if not rows:
        return [None] * len(xs), None
    y, a = np.array([r["y"] for r in rows]), np.array([[r[x] for x in xs] for r in rows], float).reshape(len(rows), len(xs))
    a, my, ma = a - a.mean(axis=0), y.mean(), a.mean(axis=0)
    used = []
    for j in range(len(xs)):
        left = a[:, j] - (a[:, used] @ np.linalg.lstsq(a[:, used], a[:, j], rcond=None)[0] if used else 0)
        if (left**2).sum() > 1e-9 * (a[:, j] ** 2).sum():
            used.append(j)
    b = np.linalg.lstsq(a[:, used], y - my, rcond=None)[0] if used else []
    out = [None] * len(xs)
    for j, v in zip(used, b, strict=True):
        out[j] = float(v)
    return out, float(my - sum(v * ma[j] for j, v in zip(used, b, strict=True)))


@pytest.mark.parametrize("entity", ["e", None])
def test_regressions_against_least_squares(spark, entity):
    df = panel(spark, 3).withColumns({"twice": 2 * F.col("x"), "fixed": F.lit(4.0), "big": F.col("z") * F.col("z") + 1e6})
    df = df if entity else df.where("e = 'A'").drop("e")
    splitter = PanelOutOfSampleSplit(5, test_size=2, missing="skip") if entity else TSOutOfSampleSplit(4, test_size=2, max_train_size=12)
    source = splitter.source(df, "t", entity)
    rows = {}
    for r in splitter.assign_rows(source).collect():
        rows.setdefault((r["fold_id"], r[entity] if entity else None), ([], []))[r["role"] == "test"].append(r)
    for xs in (["x"], ["x", "z"], ["x", "twice", "fixed", "z", "big"], ["fixed"]):
        got = {(r["fold_id"], r[entity] if entity else None): r for r in regression.fold_regressions(splitter, source, "y", xs).collect()}
        assert got.keys() == {k for k, (train, _) in rows.items() if train}
        predicted = {(r["fold_id"], r[entity] if entity else None, r["t"]): r["prediction"] for r in regression.regression_model(splitter, source, "y", xs).collect()}
        assert len(predicted) == sum(len(test) for _, test in rows.values())
        for k, (train, test) in rows.items():
            b, intercept = line_of(train, xs) if train else ([None] * len(xs), None)
            if train:
                assert [v is None for v in got[k]["coefficients"]] == [v is None for v in b]
                assert number(got[k]["coefficients"]) == pytest.approx(number(b), rel=1e-5, abs=1e-7, nan_ok=True) and got[k]["n"] == sum(None not in (r["y"], *(r[x] for x in xs)) for r in train)
            for r in test:
                value = None if intercept is None or any(r[x] is None for x in xs) else intercept + sum((v or 0) * r[x] for v, x in zip(b, xs, strict=True))
                assert predicted[(*k, r["t"])] == (value if value is None else pytest.approx(value, rel=1e-5, abs=1e-6))


def test_systems_side_by_side():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 20, 4))
    a[10:20, :, 2] = a[10:20, :, 0] + 2 * a[10:20, :, 1]
    a[20:25, :, 0] = 0
    y = rng.normal(size=(50, 20))
    got = regression.solve(np.einsum("mni,mnj->mij", a, a), np.einsum("mni,mn->mi", a, y))
    assert (np.isnan(got) == [[20 <= m < 25, False, 10 <= m < 20, False] for m in range(50)]).all()
    for m in range(50):
        used = ~np.isnan(got[m])
        assert np.allclose(got[m][used], np.linalg.lstsq(a[m][:, used], y[m], rcond=None)[0])
