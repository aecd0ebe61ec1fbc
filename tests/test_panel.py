import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronofold import PanelInSampleSplit, PanelInSampleSplitPerEntity, PanelOutOfSampleSplit, PanelOutOfSampleSplitPerEntity
from chronofold.functions import metrics
from chronofold.operators import keys as key_ops, splitters
from chronofold.operators.assign import time_bounds
from chronofold.operators.bounds import fold_bounds
from chronofold.operators.keys import Keys
from tests.folds import panel_folds

DAY = dt.date(2020, 1, 1)
KEYS = Keys("date", "entity")


def panel(spark, sizes):
    rows = [(e, DAY + dt.timedelta(i), i) for e, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "entity string, date date, value long")


def folds_of(assigned, n):
    out = [{} for _ in range(n)]
    for r in assigned.collect():
        out[r["fold_id"]].setdefault(r["entity"], ([], []))[r["role"] == "test"].append(r["pos"])
    return [{e: (sorted(a), sorted(b)) for e, (a, b) in f.items()} for f in out]


def all_of(entities, train, test):
    return {e: (list(range(*train)), list(test)) for e in entities}


@pytest.mark.parametrize("hot", [False, True])
def test_default_folds(spark, hot):
    got = PanelOutOfSampleSplit(3, test_size=3).assign(panel(spark, {"A": 20, "B": 20}), "date", "entity", hot_entities=hot)
    assert folds_of(got, 3) == [all_of("AB", (0, 11), range(11, 14)), all_of("AB", (0, 14), range(14, 17)), all_of("AB", (0, 17), range(17, 20))]


def test_gap_and_dates(spark):
    got = PanelOutOfSampleSplit(2, test_size=3, gap=5).assign(panel(spark, {"A": 30, "B": 30}), "date", "entity")
    assert folds_of(got, 2) == [all_of("AB", (0, 19), range(24, 27)), all_of("AB", (0, 22), range(27, 30))]
    got = PanelOutOfSampleSplit(test_indices=["2020-01-20", "2020-01-10"], test_size=2).assign(panel(spark, {"A": 30, "B": 30}), "date", "entity")
    assert folds_of(got, 2) == [all_of("AB", (0, 19), range(19, 21)), all_of("AB", (0, 9), range(9, 11))]


def test_in_sample(spark):
    p = panel(spark, {"A": 20, "B": 20})
    assert folds_of(PanelInSampleSplit(test_size=5).assign(p, "date", "entity"), 1) == [all_of("AB", (0, 20), [19])]
    p = panel(spark, {"A": 30, "B": 30, "C": 30})
    assert folds_of(PanelInSampleSplit(test_indices="2020-01-15", test_size=3).assign(p, "date", "entity"), 1) == [all_of("ABC", (0, 17), range(14, 17))]
    assert folds_of(PanelInSampleSplit(test_indices=["2020-01-10", "2020-01-20"], test_size=3).assign(p, "date", "entity"), 1) == [all_of("ABC", (0, 20), [9, 19])]
    run_on = PanelInSampleSplit(test_indices=[28], test_size=4, missing="skip").assign(p, "date", "entity")
    assert folds_of(run_on, 1) == [{"A": (list(range(30)), [28, 29]), "B": ([0, 1], [0, 1])}]


def test_missing_entities(spark):
    p = panel(spark, {"A": 5, "B": 3})
    with pytest.raises(ValueError, match="Cannot find test indices"):
        PanelOutOfSampleSplit(2, test_size=1).assign(p, "date", "entity")
    got = PanelOutOfSampleSplit(2, test_size=1, missing="skip").assign(p, "date", "entity")
    assert folds_of(got, 2) == [{"A": ([0, 1, 2], [3])}, {"A": ([0, 1, 2, 3], [4])}]
    with pytest.raises(ValueError, match="Cannot find"):
        PanelOutOfSampleSplit(test_indices=[("A", "2020-01-02")]).assign(p, "date", "entity")
    got = PanelOutOfSampleSplit(test_indices=[("B", "2020-01-02"), ("A", "2020-01-04")], missing="skip").assign(p, "date", "entity")
    assert folds_of(got, 2) == [{"A": ([0, 1, 2], [3])}, {"B": ([0], [1])}]
    with pytest.raises(ValueError, match="not found in panel data"):
        PanelOutOfSampleSplit(test_indices=["2025-01-01"]).assign(p, "date", "entity")
    with pytest.raises(ValueError, match="not found in panel data"):
        PanelOutOfSampleSplit(test_indices=[("B", "2020-01-05")], missing="skip").assign(p, "date", "entity")
    with pytest.raises(ValueError, match="Too many splits"):
        PanelOutOfSampleSplit(5, test_size=1).assign(p, "date", "entity")
    for entity in (None, "nothing"):
        with pytest.raises(ValueError, match="Panel data requires MultiIndex"):
            PanelOutOfSampleSplit(2).assign(p, "date", entity)


def test_random_panels_against_loops(spark):
    rng = random.Random(2)
    for mode, splitter in (("oos", PanelOutOfSampleSplit), ("is", PanelInSampleSplit)):
        times = {e: sorted(rng.sample([DAY + dt.timedelta(i) for i in range(25)], rng.randint(12, 25))) for e in "ABCD"}
        df = spark.createDataFrame([(e, t) for e, own in times.items() for t in own], "entity string, date date")
        for options in ({"k": 3, "size": 2, "m": 6}, {"k": 2, "size": 4}, {"anchors": [times["A"][4], times["B"][9]], "size": 2}):
            gap = {"gap": 1} if mode == "oos" else {}
            made = splitter(options.get("k", 5), test_size=options["size"], max_train_size=options.get("m"), test_indices=options.get("anchors"), missing="skip", **gap)
            want = panel_folds(times, mode, **options, **gap)
            assert folds_of(made.assign(df, "date", "entity"), len(want)) == want


def test_per_entity(spark):
    p = panel(spark, {"A": 15, "B": 15, "C": 15})
    splitter = PanelOutOfSampleSplitPerEntity(2, test_size=3)
    pairs = [({r["entity"] for r in b.collect()}, sorted(r["value"] for r in a.collect()), sorted(r["value"] for r in b.collect())) for a, b in splitter.split(p, "date", "entity")]
    assert pairs == [({e}, list(range(s)), list(range(s, s + 3))) for s in (9, 12) for e in "ABC"]
    assert splitter.get_n_splits(p, "date", "entity") == 6
    pairs = list(PanelInSampleSplitPerEntity(test_size=10, max_train_size=30).split(panel(spark, {"A": 50, "B": 50}), "date", "entity"))
    assert [sorted(r["value"] for r in a.collect()) for a, _ in pairs] == [list(range(20, 50))] * 2
    assert [[r["value"] for r in b.collect()] for _, b in pairs] == [[49], [49]]


def test_spread_ranks_equal_windows(spark):
    p = panel(spark, {"A": 400, "B": 3, "C": 40}).repartition(7)
    rows = lambda df: sorted(map(tuple, df.select("entity", "date", "pos", "size").collect()))
    assert rows(key_ops.ranked(p, KEYS, spread=True)) == rows(key_ops.ranked(p, KEYS, spread=False))


def test_key_checks(spark):
    rows = [("B", 2, 0), ("A", 1, 1), ("B", 1, 2), ("A", 3, 3), ("A", 2, 4), ("B", 3, 5)]
    p = spark.createDataFrame(rows, "entity string, date int, place long")
    assert not key_ops.entities_grouped(p, "place", "entity") and not key_ops.sorted_within_entities(p, "place", KEYS)
    good = p.withColumn("place", F.ascii("entity") * 10 + F.col("date"))
    assert key_ops.entities_grouped(good, "place", "entity") and key_ops.sorted_within_entities(good, "place", KEYS)
    with pytest.warns(UserWarning, match="by group then by date"):
        PanelOutOfSampleSplit(2, test_size=1).assign(p, "date", "entity", ordinal="place")
    assert key_ops.same_keys(p, p.select("entity", "date"), KEYS) and not key_ops.same_keys(p, p.where("date < 3"), KEYS)


def test_folds_described(spark):
    p = panel(spark, {"A": 20, "B": 20})
    splitter = PanelOutOfSampleSplit(2, test_size=3, gap=2)
    assigned = splitter.assign(p, "date", "entity")
    one = metrics.describe_folds(assigned, "date", ["entity"]).where("fold_id = 0 and entity = 'A'").first()
    assert (one["train_size"], one["test_size"], one["gap_days"], one["test_first"]) == (12, 3, 3, dt.date(2020, 1, 15))
    stats = metrics.split_statistics(assigned, "entity").first()
    assert (stats["folds"], stats["mean_train_size"], stats["mean_test_size"], stats["entities"]) == (2, 27.0, 6.0, 2)
    assert metrics.overlap(assigned, ["entity", "date"]).count() == 0
    inside = PanelInSampleSplit(test_indices="2020-01-10").assign(p, "date", "entity")
    assert metrics.outside_train(inside, ["entity", "date"]).count() == 0 and metrics.overlap(inside, ["entity", "date"]).count() == 2
    ranks = key_ops.ranked(p, KEYS)
    ends = {(r["fold_id"], r["role"]): (r["first"], r["last"]) for r in time_bounds(ranks, fold_bounds(ranks, KEYS, splitter.spec, key_ops.check_keys(p, KEYS))[0], KEYS).where("entity = 'B'").collect()}
    assert ends[0, "test"] == (dt.date(2020, 1, 15), dt.date(2020, 1, 17)) and ends[0, "train"] == (DAY, dt.date(2020, 1, 12))


def test_only_keys_are_read(spark, tmp_path):
    panel(spark, {"A": 20, "B": 20}).withColumn("wide", F.lit("x" * 50)).write.parquet(str(tmp_path / "p"))
    plan = PanelOutOfSampleSplit(2, test_size=2).assign(spark.read.parquet(str(tmp_path / "p")), "date", "entity")._jdf.queryExecution().executedPlan().toString()
    assert "wide" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_order_checks_by_ranges(spark):
    options = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        for fall in (None, *range(1, 16)):  # wherever it lies, also at a bound
            p = spark.createDataFrame([(i, i + (100 if fall is not None and i < fall else 0), "AB"[i >= 7]) for i in range(16)], "place int, date int, entity string")
            assert key_ops.sorted_by_time(p, "place", "date") == (fall is None)
            if fall in (None, 7, 10):
                assert key_ops.sorted_within_entities(p, "place", KEYS) == (fall != 10)
        runs = key_ops.entity_runs(p, "place", "entity")
        assert sorted(map(tuple, runs.collect())) == [("A", 7, True), ("B", 9, True)]
        assert "row_number" not in runs._jdf.queryExecution().toString()  # over all rows: one task
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_large_entity_is_ranked_by_ranges(spark, monkeypatch):
    p = panel(spark, {"A": 30, "B": 8})
    asked = []
    monkeypatch.setattr(splitters, "ranked", lambda df, keys, spread=None: asked.append(spread) or key_ops.ranked(df, keys, spread))
    for limit in (29, 30):
        monkeypatch.setattr(splitters, "SERIES_IN_ONE_TASK", limit)
        monkeypatch.setattr(key_ops, "SERIES_IN_ONE_TASK", limit)
        assert PanelOutOfSampleSplit(2, test_size=2, missing="skip").get_n_splits(p, "date", "entity") == 2
    assert asked == [True, False]


def test_reserved_names_are_refused(spark):
    p = panel(spark, {"A": 9, "B": 9})
    for name in ("pos", "Size", "fold_id", "role", "_local"):
        for old in ("date", "entity"):
            time, entity = (name, "entity") if old == "date" else ("date", name)
            with pytest.raises(ValueError, match="names of their own"):
                PanelOutOfSampleSplit(2, test_size=1).assign(p.withColumnRenamed(old, name), time, entity)
    with pytest.raises(ValueError, match="names of their own"):
        PanelOutOfSampleSplit(2, test_size=1).assign(p, "date", "date")
    wide = p.withColumn("pos", F.lit(7)).withColumn("role", F.lit("x"))  # other columns may have them
    train, test = next(iter(PanelOutOfSampleSplit(2, test_size=1).split(wide, "date", "entity")))
    assert train.columns == wide.columns and test.count() == 2


def test_each_fold_and_entity_side_by_side(spark):
    import pandas as pd

    p = panel(spark, {"A": 15, "B": 15, "C": 15})

    def sides(train, test):
        return pd.DataFrame({"train": [train["value"].tolist()], "test": [test["value"].tolist()], "columns": [",".join(train.columns)]})

    schema = "train array<long>, test array<long>, columns string"
    for splitter in (PanelOutOfSampleSplitPerEntity(2, test_size=3, gap=1), PanelInSampleSplitPerEntity(test_size=4, max_train_size=6), PanelOutOfSampleSplitPerEntity(2, test_size=3, gap=50)):
        got = sorted((r["fold_id"], r["entity"], sorted(r["train"]), sorted(r["test"])) for r in splitter.each(p, "date", "entity", sides, schema).collect())
        want = [(sorted(r["value"] for r in a.collect()), sorted(r["value"] for r in b.collect())) for a, b in splitter.split(p, "date", "entity")]
        assert [(a, b) for _, _, a, b in got] == want and [e for _, e, _, _ in got] == list("ABC") * (len(got) // 3)


def test_repeated_hours_stay_apart(spark):
    """The hour that comes twice when daylight saving ends: default folds start at either one."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        hours = spark.range(8).select(F.timestamp_seconds(F.lit(1603576800) + F.col("id") * 1800).alias("date"), "id")  # 2020-10-25, from 00:00 in half hours
        from chronofold import TSOutOfSampleSplit

        rows = TSOutOfSampleSplit(5, test_size=1).assign(hours, "date").where("role = 'test'").select("fold_id", F.unix_seconds("date").alias("s")).collect()
        assert sorted((r["fold_id"], (r["s"] - 1603576800) // 1800) for r in rows) == [(i, i + 3) for i in range(5)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_the_source_is_computed_once(spark, tmp_path):
    p = panel(spark, {"A": 20, "B": 20})
    seen = spark.sparkContext.accumulator(0)

    def count(r):
        seen.add(1)
        return r

    counted = spark.createDataFrame(p.rdd.map(count), p.schema)
    PanelOutOfSampleSplit(2, test_size=2).assign(counted, "date", "entity").collect()
    assert seen.value == 40


def test_times_as_first_seen(spark):
    days = {"A": [3, 4], "B": [1, 2, 3]}
    p = spark.createDataFrame([(e, DAY + dt.timedelta(d)) for e, own in days.items() for d in own], "entity string, date date")
    of = lambda order: PanelOutOfSampleSplit(2, test_size=1, missing="skip", time_order=order).assign(p, "date", "entity").where("role = 'test'")
    days_of = lambda order: sorted((r["fold_id"], r["entity"], (r["date"] - DAY).days) for r in of(order).collect())
    assert days_of("chronological") == [(0, "A", 3), (0, "B", 3), (1, "A", 4)]
    assert days_of("first_seen") == [(0, "B", 1), (1, "B", 2)]  # in the order 3, 4, 1, 2
    with pytest.raises(ValueError, match="time_order"):
        PanelOutOfSampleSplit(time_order="random")
