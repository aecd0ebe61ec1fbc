import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from chronofold import PanelInSampleSplit, PanelInSampleSplitPerEntity, PanelOutOfSampleSplit, PanelOutOfSampleSplitPerEntity, TSInSampleSplit, TSOutOfSampleSplit
from chronofold.functions import features, metrics
from chronofold.ml import TemporalSearch, TemporalSearchModel
from chronofold.operators import splitters
from chronofold.plans.queries import QUERIES


def rows_read(df):
    """The result and the rows that the scans of its plan gave."""
    found = df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getName() else plan
    todo = [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())] + ([node.plan()] if "QueryStage" in node.getClass().getName() else [])
        if "Scan parquet" in node.nodeName() and node.relation().location().rootPaths().mkString().endswith("/t"):
            total += node.metrics().apply("numOutputRows").value()
    return found, total


@pytest.fixture
def stored(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(4000).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("t"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.parquet.outputTimestampType")
    try:
        spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # the other kind has no statistics
        rows.repartitionByRange(8, "t").write.parquet(path)
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", before)
    return spark.read.parquet(path)


def test_slices_of_a_series_read_their_times_alone(spark, stored):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # with hours that repeat
        pairs = list(TSOutOfSampleSplit(3, test_size=200, gap=5, max_train_size=300).split(stored, "t"))
        for i, (train, test) in enumerate(pairs):
            lo = 4000 - (3 - i) * 200
            for side, span in ((train, range(lo - 305, lo - 5)), (test, range(lo, lo + 200))):
                found, read = rows_read(side)
                assert sorted(r["v"] for r in found) == list(span) and 0 < read < 1600
                plan = side._jdf.queryExecution().toString()
                assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t," in plan and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_slices_of_sets_and_panels(spark, stored):
    (train, test), = TSInSampleSplit(test_indices=[10, 12, 40], max_train_size=20).split(stored, "t")
    assert sorted(r["v"] for r in test.collect()) == [10, 12, 40] and sorted(r["v"] for r in train.collect()) == list(range(21, 41))
    panel = stored.withColumn("e", F.when(F.col("v") % 2 == 0, "A").otherwise("B"))
    pairs = list(PanelOutOfSampleSplit(2, test_size=50, gap=1, max_train_size=60, missing="skip").split(panel, "t", "e"))
    expected = PanelOutOfSampleSplit(2, test_size=50, gap=1, max_train_size=60, missing="skip").assign_rows(panel, "t", "e").collect()
    for i, pair in enumerate(pairs):
        for role, side in zip(("train", "test"), pair, strict=True):
            found, read = rows_read(side)
            assert sorted(r["v"] for r in found) == sorted(r["v"] for r in expected if (r["fold_id"], r["role"]) == (i, role)) and read < 2000
    empty = list(TSOutOfSampleSplit(2, test_size=3, gap=5000).split(stored, "t"))
    assert [(a.count(), b.count()) for a, b in empty] == [(0, 3), (0, 3)]


def panel(spark, sizes, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(e, t, rng.random(), rng.random()) for e, n in sizes.items() for t in rng.sample(range(5 * n), n)], "e string, t int, y double, p double")


def test_large_entities_are_found_and_spread(spark, monkeypatch):
    df = panel(spark, {"hot": 900, "A": 40, "B": 59, "C": 1}).repartition(4)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    works = [lambda d: features.lag_features(d, "y", [1, -2, 7], "t", "e"), lambda d: features.align_horizon(d, "y", 3, "t", "e"), lambda d: features.publication_delay(d, ["y", "p"], 2, "t", "e"), lambda d: features.trend(d, "t", "e")]
    plain = [w(df) for w in works]
    accuracy = metrics.direction_accuracy(df, "y", "p", "t", ["e"]).collect()
    monkeypatch.setattr(features, "SERIES_IN_ONE_TASK", 100)
    monkeypatch.setattr(features, "ROWS_A_BLOCK", 100)
    spread = []
    real = features.with_places
    monkeypatch.setattr(features, "with_places", lambda d, keys: spread.append({r[0] for r in d.select(keys.entity).distinct().collect()}) or real(d, keys))
    for work, expected in zip(works, plain, strict=True):
        got = work(df)
        assert same(got, expected.select(got.columns))
    assert spread == [{"hot"}] * 4
    assert {r["e"]: r["direction_accuracy"] for r in metrics.direction_accuracy(df, "y", "p", "t", ["e"]).collect()} == pytest.approx({r["e"]: r["direction_accuracy"] for r in accuracy})
    assert len(spread) == 5
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        in_a_task = features.lag_features(df, "y", [1], "t", "e").groupBy(F.spark_partition_id()).agg(F.count("y_lag_1").alias("n")).agg(F.max("n")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert in_a_task <= 400  # a few blocks that share a task, of 1,000 rows


@pytest.mark.parametrize("kind", [PanelOutOfSampleSplitPerEntity, PanelInSampleSplitPerEntity])
def test_streamed_groups(spark, kind):
    df = panel(spark, {"A": 120, "B": 31, "C": 2}).withColumn("role", F.lit("x")).repartition(3)
    options = {"n_splits": 3} if kind is PanelOutOfSampleSplitPerEntity else {"test_indices": [5, 9, 130], "max_train_size": 50}
    splitter = kind(test_size=2, missing="skip", **options)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def fit(train, test):
        a, b = list(train), list(test)
        x, y = (pd.concat(f) if f else pd.DataFrame({"t": [], "y": [], "role": []}) for f in (a, b))
        yield pd.DataFrame({"n": [len(x), len(y)], "total": [float(x["y"].sum()), float(y["y"].sum())], "risen": [bool(x["t"].is_monotonic_increasing), bool(y["t"].is_monotonic_increasing)], "largest": [max([len(f) for f in a + b], default=0)] * 2})

    def lazy(train, test):
        yield pd.DataFrame({"first": [float(next(iter(f))["t"].iloc[0]) for f in (test,)]})  # leaves all of train

    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        got = splitter.each_streamed(df, "t", "e", fit, "n long, total double, risen boolean, largest long").collect()
        firsts = {(r["fold_id"], r["e"]): r["first"] for r in splitter.each_streamed(df, "t", "e", lazy, "first double").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    sides = {}
    for r in splitter.assign_rows(df.drop("role"), "t", "e").collect():
        sides.setdefault((r["fold_id"], r["e"]), ([], []))[r["role"] == "test"].append(r)
    assert firsts == {k: min(r["t"] for r in test) for k, (_, test) in sides.items()}
    assert sorted((r["fold_id"], r["e"], r["n"], round(r["total"], 9)) for r in got) == sorted((*k, len(s), round(sum(r["y"] for r in s), 9)) for k, both in sides.items() for s in both)
    assert all(r["risen"] and r["largest"] <= 10 for r in got)


def test_search_over_folds(spark, tmp_path):
    df = panel(spark, {"A": 60, "B": 40}).withColumn("y", 3 + 2 * F.col("p") + F.col("y") / 100)
    line = LinearRegression(labelCol="y")
    steps = Pipeline(stages=[VectorAssembler(inputCols=["p"], outputCol="features"), line])
    splitter = PanelOutOfSampleSplit(2, test_size=5, missing="skip")
    search = TemporalSearch(steps, [{line.fitIntercept: False}, {line.fitIntercept: True}], RegressionEvaluator(labelCol="y"), splitter, "t", "e")
    found = search.fit(df)
    assert found.best == 1 and found.maps == [{"fitIntercept": False}, {"fitIntercept": True}] and max(found.metrics[1]) < min(found.metrics[0])
    assert [(r["map"], r["fold_id"]) for r in found.by_fold(spark).orderBy("map", "fold_id").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    found.save(f"{tmp_path}/search")
    again = TemporalSearchModel.load(f"{tmp_path}/search")
    of = lambda m: sorted(r["prediction"] for r in m.transform(df).collect())
    assert of(again) == of(found) and (again.best, again.metrics, again.maps) == (found.best, found.metrics, found.maps)
    assert PanelInSampleSplit is not None
    with pytest.raises(ValueError, match="no param maps"):
        TemporalSearch(steps, [], RegressionEvaluator(), splitter, "t", "e")


def test_slices_of_equal_times(spark, tmp_path, monkeypatch):
    """The query over events that share their times: each side is what their order by time and id says, by either join."""
    rows = [(t, k * 500 + i, float(t % 7 + k)) for k in range(5) for i, t in enumerate(range(500))]
    random.Random(3).shuffle(rows)
    events = spark.createDataFrame(rows, "t int, event_id long, value double").select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours="t")).alias("ts"), "event_id", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    rows.sort()
    n, size = len(rows), len(rows) // 4
    expected = {}
    for i in range(3):
        lo = n - (3 - i) * size
        for role, side in (("test", rows[lo : lo + size]), ("train", rows[max(0, lo - 710) : max(0, lo - 10)])):
            expected[i, role] = len(side), round(sum(r[2] for r in side), 4), side[0][0], side[-1][0]
    for most, kind in ((10**6, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(splitters, "BROADCAST_KEYS", most)
        out = QUERIES["split_slices"](spark, str(tmp_path))
        hours = lambda t: int((t - dt.datetime(2024, 1, 1)).total_seconds() // 3600)
        with monkeypatch.context() as m:
            m.setenv("TZ", "UTC")
            time.tzset()
            assert {(r["fold_id"], r["role"]): (r["n"], r["total"], hours(r["first"]), hours(r["last"])) for r in out.collect()} == expected
        time.tzset()
        assert kind in out._jdf.queryExecution().executedPlan().toString()
