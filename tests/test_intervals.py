import random

import pytest
from pyspark.sql import functions as F

from chronofold import InSampleSplit, PanelOutOfSampleSplit, TSInSampleSplit, TSOutOfSampleSplit
from chronofold.operators import assign as assigning
from chronofold.operators import bounds as bounding
from tests.folds import panel_folds, series_folds


def series(spark, n):
    return spark.range(n).select(F.col("id").alias("t"), (F.col("id") * 2.0).alias("y"))


def folds_of(df, k):
    found = [([], []) for _ in range(k)]
    for r in df.collect():
        found[r["fold_id"]][r["role"] == "test"].append(r["pos"])
    return [(sorted(a), sorted(b)) for a, b in found]


@pytest.mark.parametrize("n, k, size, gap, m", [(300, 40, 3, 2, 17), (131, 60, 2, 1, None), (257, 100, 1, 0, 64), (1000, 33, 7, 5, 100), (90, 80, 1, 200, 4)])
def test_many_folds_of_a_series(spark, n, k, size, gap, m):
    got = folds_of(TSOutOfSampleSplit(k, test_size=size, gap=gap, max_train_size=m).assign(series(spark, n), "t"), k)
    assert got == series_folds(n, k=k, size=size, gap=gap, m=m)


def test_many_places_of_one_test(spark):
    places = sorted(random.Random(1).sample(range(500), 50)) + [7, 7]
    got = folds_of(TSInSampleSplit(test_indices=places, max_train_size=200).assign(series(spark, 500), "t"), 1)
    assert got == series_folds(500, "is", anchors=places, m=200)


def test_blocks_equal_arrays_in_every_width(spark, monkeypatch):
    """Folds that fit a literal, by blocks of any width, broadcast or joined, of a series and a panel."""
    rng = random.Random(5)
    panel = spark.createDataFrame([(e, t) for e, n in (("A", 40), ("B", 11), ("C", 1)) for t in rng.sample(range(60), n)], "e string, t int")
    cases = [(TSOutOfSampleSplit(9, test_size=3, max_train_size=20), series(spark, 100), "t", None), (InSampleSplit(test_indices=[3, 50, 51, 99]), series(spark, 100), "t", None), (PanelOutOfSampleSplit(5, test_size=4, gap=1, missing="skip"), panel, "t", "e")]
    for splitter, df, time, entity in cases:
        source = splitter.source(df, time, entity)
        plain = sorted(map(tuple, splitter.assign(source).collect()))
        with monkeypatch.context() as m:
            m.setattr(assigning, "LITERAL_FOLDS", 0)
            for limit in (0, 10**6):
                m.setattr(assigning, "BROADCAST_BLOCKS", limit)
                assert sorted(map(tuple, splitter.assign(source).collect())) == plain
            for role in ("train", "test"):
                assert sorted(map(tuple, splitter.assign(source, role=role).collect())) == [r for r in plain if r[1] == role]
        for role in ("train", "test"):
            assert sorted(map(tuple, splitter.assign(source, role=role).collect())) == [r for r in plain if r[1] == role]


def test_many_folds_of_a_panel(spark):
    rng = random.Random(2)
    times = {e: sorted(rng.sample(range(90), n)) for e, n in (("A", 80), ("B", 45), ("C", 3))}
    df = spark.createDataFrame([(e, t) for e, own in times.items() for t in own], "e string, t int")
    got = {}
    for r in PanelOutOfSampleSplit(50, test_size=1, gap=1, max_train_size=9, missing="skip").assign(df, "t", "e").collect():
        got.setdefault((r["fold_id"], r["e"]), ([], []))[r["role"] == "test"].append(r["pos"])
    expected = {(i, e): sides for i, fold in enumerate(panel_folds(times, k=50, size=1, gap=1, m=9)) for e, sides in fold.items()}
    assert {k: (sorted(a), sorted(b)) for k, (a, b) in got.items()} == expected


def test_plans_hold_no_long_literal(spark):
    sizes = [len(TSOutOfSampleSplit(k, test_size=1, max_train_size=5).assign(series(spark, 2000), "t")._jdf.queryExecution().toString()) for k in (50, 1500)]
    assert bounding.LITERAL_FOLDS == assigning.LITERAL_FOLDS == 32 and sizes[1] < 1.1 * sizes[0]


def test_a_saved_source_serves_all_methods(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    df = series(spark, 40).coalesce(1).mapInArrow(counted, "t long, y double")
    splitter = TSOutOfSampleSplit(3, test_size=2)
    source = splitter.source(df, "t")
    rows = splitter.assign_rows(source)
    assert rows.columns == ["fold_id", "role", "t", "y"] and splitter.get_n_splits(source) == 3 and splitter.bounds(source).count() == 3
    assert all(r["y"] == 2.0 * r["t"] for r in rows.collect()) and rows.count() == splitter.assign(source).count()
    assert runs.value == 40
    with pytest.raises(ValueError, match="panel|entity"):
        PanelOutOfSampleSplit(2).assign(source)


def test_columns_of_any_name_go_along(spark):
    df = series(spark, 30).withColumns({"pos": F.lit("a"), "size": F.lit("b"), "_b": F.lit("c"), "test_lo": F.lit(1)})
    with pytest.raises(ValueError, match="names of their own"):
        TSOutOfSampleSplit(2, test_size=2).assign_rows(df.withColumn("role", F.lit(1)), "t")
    rows = TSOutOfSampleSplit(2, test_size=2).assign_rows(df, "t")
    assert rows.columns == ["fold_id", "role", *df.columns] and {(r["pos"], r["size"], r["_b"]) for r in rows.collect()} == {("a", "b", "c")}


def test_many_bounds_are_never_broadcast(spark, monkeypatch):
    """However few bytes Spark expects of them."""
    df = spark.range(600).select((F.col("id") % 6).alias("e"), (F.col("id") / 6).cast("int").alias("t"))
    for limit, k in (("BROADCAST_BLOCKS", 40), ("BROADCAST_BOUNDS", 3)):
        splitter = PanelOutOfSampleSplit(k, test_size=1, max_train_size=6)
        for most, kind in ((10**6, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(assigning, limit, most)
            out = splitter.assign(df, "t", "e")
            assert out.count() == 6 * 7 * k
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert {x for x in ("BroadcastHashJoin", "SortMergeJoin") if x in plan} == {kind}
