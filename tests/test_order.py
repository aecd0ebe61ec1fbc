import random
import warnings

import pytest
from pyspark.sql import functions as F

from chronofold import PanelInSampleSplit, PanelOutOfSampleSplit, PanelOutOfSampleSplitPerEntity, TSInSampleSplit, TSOutOfSampleSplit
from chronofold.operators import bounds as bounding
from chronofold.operators import keys as key_ops
from tests.folds import panel_folds, series_folds


@pytest.fixture
def files(spark, tmp_path):
    """300 rows in files of odd sizes, one of them empty, with several row groups; v is the row's place in the order of paths."""
    at = 0
    for i, n in enumerate((120, 0, 1, 150, 29)):
        df = spark.range(at, at + n).select(F.col("id").alias("v"), (F.col("id") % 7).alias("e")).coalesce(1)
        df.write.option("parquet.block.size", 256).parquet(f"{tmp_path}/t/part={i}")
        at += n
    return f"{tmp_path}/t/"


@pytest.mark.parametrize("spread", [False, True])
def test_stored_positions_by_any_number_of_tasks(spark, files, monkeypatch, spread):
    if spread:
        monkeypatch.setattr(key_ops, "SERIES_IN_ONE_TASK", 1)
        monkeypatch.setattr(key_ops, "BROADCAST_FILES", 0)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = key_ops.with_stored_positions(spark.read.parquet(files), "place")
            assert rows.columns == ["v", "e", "part", "place"] and all(r["v"] == r["place"] for r in rows.collect()) and rows.count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert key_ops.with_stored_positions(spark.read.parquet(files).limit(0) if False else spark.read.parquet(f"{files}part=1")).count() == 0


def test_warnings_by_stored_order(spark, files):
    df = spark.read.parquet(files)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        TSOutOfSampleSplit(2).assign(df.select("v", "_metadata"), "v", ordinal=key_ops.STORED)
    with pytest.warns(UserWarning, match="not sorted by date"):
        TSOutOfSampleSplit(2).assign(df.select((-F.col("v")).alias("v"), "_metadata"), "v", ordinal=key_ops.STORED)
    with pytest.warns(UserWarning, match="not sorted by group"):
        PanelOutOfSampleSplit(2, missing="skip").assign(df.select("v", "e", "_metadata"), "v", "e", ordinal=key_ops.STORED)


@pytest.mark.parametrize("spread", [False, True])
def test_sums_before(spark, spread):
    rng = random.Random(3)
    rows = [(i, rng.randrange(9)) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(5)
    got = key_ops.summed_before(df, ["k"], "n", "before", spread)
    assert got.columns == ["k", "n", "before"]
    assert sorted(map(tuple, got.collect())) == [(k, n, sum(m for j, m in rows if j < k)) for k, n in sorted(rows)]


def test_offsets_of_entities_by_ranges(spark, monkeypatch):
    times = {e: list(range(n)) for e, n in zip("DABC", (7, 5, 1, 9), strict=True)}
    df = spark.createDataFrame([(e, t) for e, own in times.items() for t in own], "e string, t int").repartition(3)
    plain = sorted(map(tuple, PanelInSampleSplit(test_indices=[4], test_size=5, missing="skip").assign(df, "t", "e").collect()))
    asked = []
    real = key_ops.summed_before
    monkeypatch.setattr(bounding, "SERIES_IN_ONE_TASK", 1)
    monkeypatch.setattr(bounding, "summed_before", lambda *a: asked.append(a[-1]) or real(*a))
    assert sorted(map(tuple, PanelInSampleSplit(test_indices=[4], test_size=5, missing="skip").assign(df, "t", "e").collect())) == plain
    assert asked and all(asked) and {r[2] for r in plain if r[1] == "test"} == {"A", "B", "C"}


def repeated(n, seed=0):
    """(time, tiebreak) pairs in their order, with repeated times."""
    rng = random.Random(seed)
    return sorted({(rng.randrange(n // 3), rng.randrange(1000)) for _ in range(n)})


def folds_of(df, k):
    found = [([], []) for _ in range(k)]
    for r in df.collect():
        found[r["fold_id"]][r["role"] == "test"].append(r["pos"])
    return [(sorted(a), sorted(b)) for a, b in found]


def test_repeated_times_of_a_series(spark):
    rows = repeated(60)
    df = spark.createDataFrame(rows, "t int, id int").repartition(4)
    n = len(rows)
    got = TSOutOfSampleSplit(4, test_size=7, gap=2, max_train_size=20, tiebreak="id").assign(df, "t")
    assert got.columns == ["fold_id", "role", "t", "id", "pos"] and folds_of(got, 4) == series_folds(n, k=4, size=7, gap=2, m=20)
    assert all(rows[r["pos"]] == (r["t"], r["id"]) for r in got.collect())
    dated = df.select(F.date_add(F.lit("2020-01-01").cast("date"), "t").alias("t"), "id")
    anchor = [i for i, r in enumerate(rows) if r[0] == rows[30][0]][0]
    day = str(dated.where(F.col("id") == rows[30][1]).where(F.date_add(F.lit("2020-01-01").cast("date"), rows[30][0]) == F.col("t")).first()["t"])
    assert folds_of(TSInSampleSplit(test_indices=day, test_size=3, tiebreak="id").assign(dated, "t"), 1) == series_folds(n, "is", size=3, anchors=[anchor])
    with pytest.raises(ValueError, match="repeated"):
        TSOutOfSampleSplit(2).assign(df, "t")
    with pytest.raises(ValueError, match="repeated"):
        TSOutOfSampleSplit(2, tiebreak="id").assign(df.union(df.limit(1)), "t")
    with pytest.raises(ValueError, match="null"):
        TSOutOfSampleSplit(2, tiebreak="id").assign(df.withColumn("id", F.nullif("id", F.lit(rows[0][1]))), "t")
    with pytest.raises(ValueError, match="no column"):
        TSOutOfSampleSplit(2, tiebreak="other").assign(df, "t")


def test_repeated_times_of_a_panel(spark):
    own = {"A": repeated(50, 1), "B": repeated(31, 2)}
    df = spark.createDataFrame([(e, *r) for e, rows in own.items() for r in rows], "e string, t int, id int").repartition(3)
    first = {e: [r[0] for r in rows] for e, rows in own.items()}
    for hot in (False, True):
        splitter = PanelOutOfSampleSplit(3, test_size=2, gap=1, missing="skip", tiebreak=["id"])
        got = {}
        for r in splitter.assign(df, "t", "e", hot_entities=hot).collect():
            assert own[r["e"]][r["pos"]] == (r["t"], r["id"])
            got.setdefault((r["fold_id"], r["e"]), ([], []))[r["role"] == "test"].append(r["pos"])
        expected = {(i, e): s for i, fold in enumerate(panel_folds(first, k=3, size=2, gap=1)) for e, s in fold.items()}
        assert {k: (sorted(a), sorted(b)) for k, (a, b) in got.items()} == expected
    pairs = list(splitter.split(df, "t", "e"))
    assert len(pairs) == 3 and all(a.columns == ["e", "t", "id"] for a, _ in pairs)
    each = PanelOutOfSampleSplitPerEntity(2, test_size=2, missing="skip", tiebreak="id")
    order = each.each(df, "t", "e", lambda train, test: train.assign(ok=(train["t"] * 1000 + train["id"]).is_monotonic_increasing)[["ok"]], "ok boolean")
    assert {r["ok"] for r in order.collect()} == {True}
