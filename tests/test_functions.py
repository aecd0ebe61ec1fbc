import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chronofold import PanelOutOfSampleSplit, TSOutOfSampleSplit
from chronofold.functions import features, metrics, models
from chronofold.sources import synthetic


def series(spark, values):
    return spark.createDataFrame([(dt.date(2020, 1, 6) + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "t date, y double")


def test_features(spark):
    df = series(spark, range(10))
    ahead = features.align_horizon(df, "y", 3, "t")
    assert sorted((r["y"], r["target_ahead"]) for r in ahead.collect()) == [(float(i), float(i + 3)) for i in range(7)]
    lagged = features.complete_rows(features.lag_features(df, "y", [1, 4], "t"))
    assert sorted((r["y"], r["y_lag_1"], r["y_lag_4"]) for r in lagged.collect()) == [(float(i), i - 1.0, i - 4.0) for i in range(4, 10)]
    first = features.trend(features.calendar_features(df, "t"), "t").orderBy("t").first()
    assert (first["day_of_week"], first["month"], first["day_of_year"], first["trend"]) == (0, 1, 6, 0)
    assert [r["y"] for r in features.publication_delay(df, ["y"], 2, "t").orderBy("t").collect()][:3] == [None, None, 0.0]
    assert features.gap_for(3, 2) == 5
    with pytest.raises(ValueError):
        features.gap_for(-1, 0)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 3.0), (2, 0.0, 1.0), (3, 2.0, 0.0)], "t int, y double, p double")
    r = df.agg(metrics.rmse("y", "p").alias("rmse"), metrics.mae("y", "p").alias("mae"), metrics.mape("y", "p").alias("mape")).first()
    assert math.isclose(r["rmse"], math.sqrt(6 / 4)) and r["mae"] == 1.0 and math.isclose(r["mape"], 100 * (1 + 0 + 1) / 3)
    assert metrics.direction_accuracy(df, "y", "p", "t").first()[0] == 0.5
    s = metrics.fold_summary(df, "y").first()
    assert s["folds"] == 4 and math.isclose(s["std_pop"], 1.118033988749895) and math.isclose(s["std_samp"], 1.2909944487358056)


def test_models(spark):
    df = series(spark, [2 * i + 3 for i in range(20)]).withColumn("x", (F.col("y") - 3) / 2)
    folds = TSOutOfSampleSplit(2, test_size=3).assign(df, "t")
    rows = models.linear_model(df, folds, ["t"], "y", "x").collect()
    assert len(rows) == 6 and all(math.isclose(r["prediction"], r["y"]) for r in rows)
    ratio = models.ratio_model(df, folds, ["t"], "y", "x").where("fold_id = 0").orderBy("t").first()
    assert math.isclose(ratio["prediction"], ratio["x"] * sum((2 * i + 3) / i for i in range(1, 14)) / 13)


def test_ml_driver(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from chronofold.ml import cross_validate

    df = series(spark, [2 * i + 3 for i in range(20)]).withColumn("x", (F.col("y") - 3) / 2)
    steps = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")])
    assert all(s < 1e-6 for s in cross_validate(steps, RegressionEvaluator(labelCol="y"), TSOutOfSampleSplit(2, test_size=3), df, "t"))


def test_synthetic_data_do_not_depend_on_partitions(spark):
    s = synthetic.synthetic_series(spark, 60)
    assert s.count() == 60 and s.collect() == synthetic.synthetic_series(spark, 60).collect()
    p = synthetic.synthetic_panel(spark, 6, 48)
    rows = sorted(map(tuple, p.collect()))
    assert rows == sorted(map(tuple, synthetic.synthetic_panel(spark, 6, 48).repartition(5).collect()))
    assert 0.85 < len(rows) / (6 * 48) < 1 and PanelOutOfSampleSplit(3, missing="skip").get_n_splits(p, "date", "entity") == 3


def test_shifts_by_ranges_equal_one_window(spark, monkeypatch):
    monkeypatch.setattr(features, "ROWS_A_BLOCK", 4)
    one = series(spark, range(23)).repartition(3)
    two = one.select(F.lit("a").alias("e"), "*").unionByName(one.where("y < 5").select(F.lit("b").alias("e"), "*"))
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    for df, entity in ((one, None), (two, "e")):
        for made in (
            lambda d, e, s: features.lag_features(d, "y", [1, 6, 11], "t", e, spread=s),
            lambda d, e, s: features.align_horizon(d, "y", 7, "t", e, spread=s),
            lambda d, e, s: features.align_horizon(d, "y", 0, "t", e, spread=s),
            lambda d, e, s: features.publication_delay(d, ["y"], 3, "t", e, spread=s),
            lambda d, e, s: features.trend(d, "t", e, spread=s),
        ):
            assert rows(made(df, entity, True)) == rows(made(df, entity, False))


def test_a_long_series_is_spread(spark, monkeypatch):
    asked = []
    real = features.with_places
    monkeypatch.setattr(features, "with_places", lambda df, keys: asked.append(keys) or real(df, keys))
    df = series(spark, range(8))
    for limit in (8, 7):
        monkeypatch.setattr(features, "SERIES_IN_ONE_TASK", limit)
        assert features.lag_features(df, "y", [1], "t").where("y_lag_1 is null").count() == 1
    assert len(asked) == 1


def test_sections(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1), ("a", dt.date(2020, 1, 2), 2), ("b", dt.date(2020, 1, 1), 3), (None, None, 4)], "e string, t date, v int")
    assert sorted(r[0] or "" for r in features.entities(df, "e").collect()) == ["", "a", "b"]
    assert sorted(map(tuple, features.entity_section(df, "e", "a").collect())) == [(dt.date(2020, 1, 1), 1), (dt.date(2020, 1, 2), 2)]
    assert sorted(map(tuple, features.time_section(df, "t", "2020-01-01").collect())) == [("a", 1), ("b", 3)]
    assert features.entity_section(df, "e", None).first()["v"] == 4


def test_forest_folds_repeat(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from chronofold.ml import cross_validate

    df = series(spark, [i % 7 for i in range(60)]).withColumn("x", F.dayofweek("t").cast("double"))
    steps = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), RandomForestRegressor(labelCol="y", numTrees=5, seed=1)])
    scores = [cross_validate(steps, RegressionEvaluator(labelCol="y"), TSOutOfSampleSplit(2, test_size=7), df, "t") for _ in range(2)]
    assert scores[0] == scores[1] and max(scores[0]) < 1.5
