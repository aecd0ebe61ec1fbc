"""Keys of a time series or panel: checks, and the rank of each row within its entity."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.scratch import Scratch


#: A series, or an entity of a panel, of so many rows at most is ranked by one task; a longer one by ranges.
SERIES_IN_ONE_TASK = 1_000_000

#: Files whose row counts are broadcast at most.
BROADCAST_FILES = 100_000
#: Names the order of rows in their files in place of a column.
STORED = "_metadata"

#: Columns of ranks, bounds and assignments; a key column can't have one of these names, nor begin with an underscore.
RESERVED = frozenset(("fold_id", "role", "pos", "size", "test_lo", "test_hi", "points", "n_test", "train_lo", "train_hi"))


@dataclass(frozen=True)
class Shape:
    """What the driver knows of the data: rows, entities, distinct times (0: not counted), rows of the largest entity (at most)."""

    rows: int
    entities: int
    times: int
    largest: int


@dataclass(frozen=True)
class Keys:
    """Columns that identify a row: the time and, for a panel, the entity. Where times repeat in an entity, ``tiebreak`` columns put their rows in order."""

    time: str
    entity: str | None = None
    tiebreak: tuple[str, ...] = ()

    @property
    def within(self) -> list[str]:
        return [] if self.entity is None else [self.entity]

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tiebreak]

    @property
    def columns(self) -> list[str]:
        return [*self.within, *self.order]

    def check(self, df: DataFrame) -> None:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            kind = "Panel data requires MultiIndex keys (entity and time)" if self.entity else "A time column is required"
            raise ValueError(f"{kind}: no column {', '.join(missing)}")
        taken = [c for c in self.columns if c.lower() in RESERVED or c.startswith("_")]
        if taken or len({c.lower() for c in self.columns}) < len(self.columns):
            raise ValueError(f"key columns need names of their own, not {', '.join(taken or self.columns)}: rename them")


def sorted_by_time(df: DataFrame, ordinal: str, time: str) -> bool:
    """Whether time never falls along the ordinal column."""
    return not _falls(df, ordinal, time, [])


def sorted_within_entities(df: DataFrame, ordinal: str, keys: Keys) -> bool:
    """Whether time never falls along the ordinal column inside an entity."""
    return not _falls(df, ordinal, keys.time, [keys.entity])


def _in_ranges(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows sorted over range partitions, written (bounds are sampled), with ``_part``, the partition, and ``_local``, the place in it."""
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    return Scratch(df.sparkSession).save(ordered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_local", F.expr("_id & 8589934591L")).drop("_id"), "ranked")


def stored(df: DataFrame) -> Column:
    """Where a row of files stands as a value to order by: the file's path, then the row's place in the file. No column of the data is read for it."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def with_stored_positions(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """All columns of a table just read from Parquet files and ``name``: the 0-based position of the row, files in the order of their paths.

    Rows of a file are counted by their places alone, and counts summed up over the files; how the files are split among tasks doesn't matter.
    """
    file = F.col("_metadata.file_path").alias("_file")
    counts = df.select(file).groupBy("_file").agg(F.count("*").alias("_n"))
    counts = Scratch(df.sparkSession).save(counts, "files")
    n = counts.count()
    before = summed_before(counts, ["_file"], "_n", "_before", n > SERIES_IN_ONE_TASK).select("_file", "_before")
    rows = df.select("*", file, F.col("_metadata.row_index").alias("_row"))
    met = rows.join(F.broadcast(before) if n <= BROADCAST_FILES else before, "_file")
    return met.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_before") + F.col("_row")).alias(name))


def summed_before(df: DataFrame, by: list[str], value: str, name: str, spread: bool) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, in the order of ``by``. ``spread``: in range partitions, whose sums are added up first, so no task has all rows."""
    earlier = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if not spread:
        return df.withColumn(name, earlier(W.orderBy(*by)))
    rows = _in_ranges(df, by)
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = parts.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_parts_before"))  # a row a partition
    summed = rows.withColumn(name, earlier(W.partitionBy("_part").orderBy("_local"))).join(F.broadcast(before), "_part")
    return summed.withColumn(name, F.col(name) + F.col("_parts_before")).select(*df.columns, name)


def _falls(df: DataFrame, ordinal: str, time: str, partition: list[str]) -> bool:
    """Neighbours are compared inside range partitions, then each partition's first row with the last one before it."""
    rows = _in_ranges(df.select(*partition, F.col(ordinal).alias("_ordinal"), F.col(time).alias("_time")), [*partition, "_ordinal"])
    falls = lambda before, now: F.coalesce(before > F.col(now), F.lit(False)).alias("falls")
    inside = rows.select(falls(F.lag("_time").over(W.partitionBy("_part", *partition).orderBy("_local")), "_time"))
    ends = rows.groupBy("_part", *partition).agg(F.min_by("_time", "_local").alias("first"), F.max_by("_time", "_local").alias("last"))
    across = ends.select(falls(F.lag("last").over(W.partitionBy(*partition).orderBy("_part")), "first"))
    return inside.unionByName(across).agg(F.max("falls")).first()[0] or False


def entity_runs(df: DataFrame, ordinal: str, entity: str) -> DataFrame:
    """Per entity: its rows, and whether they stand together along the ordinal column (as many places as rows between its ends)."""
    rows = _in_ranges(df.select(entity, F.col(ordinal).alias("_ordinal")), ["_ordinal"])
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    placed = rows.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").select(entity, (F.col("_local") + F.col("_before")).alias("place"))
    return placed.groupBy(entity).agg(F.count("*").alias("n"), (F.max("place") - F.min("place") + 1 == F.count("*")).alias("together"))


def entities_grouped(df: DataFrame, ordinal: str, entity: str) -> bool:
    return bool(entity_runs(df, ordinal, entity).agg(F.coalesce(F.min("together"), F.lit(True))).first()[0])


def warn_if_unsorted(df: DataFrame, ordinal: str, keys: Keys) -> None:
    """Order never matters here, since rows are identified by key; a caller who expects it is told. ``STORED`` as the ordinal: the order of the rows in their files."""
    if ordinal == STORED:
        df = df.select(*keys.columns, stored(df).alias("_stored"))
        ordinal = "_stored"
    if keys.entity is None:
        if not sorted_by_time(df, ordinal, keys.time):
            warnings.warn("X is not sorted by date; rows are ranked by date.", stacklevel=3)
    elif not (entities_grouped(df, ordinal, keys.entity) and sorted_within_entities(df, ordinal, keys)):
        warnings.warn("X is not sorted by group then by date; rows are ranked by group and date.", stacklevel=3)


def same_keys(x: DataFrame, y: DataFrame, keys: Keys) -> bool:
    """Whether two frames hold the same keys, each as often."""
    count = lambda df, name: df.groupBy(*keys.columns).agg(F.count("*").alias(name))
    both = count(x, "nx").join(count(y, "ny"), keys.columns, "full")
    return both.where("nx is null or ny is null or nx <> ny").limit(1).count() == 0


def ranked(df: DataFrame, keys: Keys, spread: bool | None = None, data: bool = False) -> DataFrame:
    """The keys (with ``data`` all columns) with ``pos``, the 0-based rank of a row within its entity, and ``size``, the entity's rows.

    With ``spread`` rows are range-partitioned by (entity, time), so that an entity of any size, or a single long series, is
    ranked by many tasks; its offsets come from one small count a partition and entity. Without, one window over each entity
    does it with one shuffle by entity. The default spreads a series (a caller who knows that it is short need not) and not a panel.
    """
    keys.check(df)
    spread = keys.entity is None if spread is None else spread
    own = df if data else df.select(*keys.columns)
    return with_places(own, keys) if spread else _by_window(own, keys)


def _by_window(df: DataFrame, keys: Keys) -> DataFrame:
    w = W.partitionBy(*keys.within)
    return df.withColumn("pos", F.row_number().over(w.orderBy(*keys.order)).cast("long") - 1).withColumn("size", F.count("*").over(w))


def with_places(df: DataFrame, keys: Keys) -> DataFrame:
    """All columns of the rows with ``pos`` and ``size``, ranked by ranges (equal keys in any order)."""
    saved = _in_ranges(df, keys.columns)
    if keys.entity is not None:  # a null entity is one of its own
        saved = saved.withColumn("_entity", F.struct(F.col(keys.entity)))
    by = ["_part"] if keys.entity is None else ["_part", "_entity"]
    counts = saved.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    inside = W.partitionBy(*by[1:])
    starts = counts.select(*by, "_first", (F.sum("_n").over(inside.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(inside).alias("size"))
    if keys.entity is None:
        starts = F.broadcast(starts)  # a row a partition
    return saved.join(starts, by).select(*df.columns, (F.col("_local") - F.col("_first") + F.col("_before")).alias("pos"), "size")


@dataclass(frozen=True)
class Source:
    """Ranked keys, written to the shared folder: the keys, pos, size and, if asked for, all other columns as the struct ``_data``."""

    keys: Keys
    ranks: DataFrame
    shape: Shape


def _nulls(keys: Keys):
    return reduce(or_, (F.col(c).isNull() for c in keys.columns))


def ranked_at_once(own: DataFrame, keys: Keys) -> Source:
    """Ranks the rows by one window and checks them by an observation of the same write."""
    own_key = F.struct(*keys.order)
    again = F.coalesce(F.lag(own_key).over(W.partitionBy(*keys.within).orderBy(*keys.order)) == own_key, F.lit(False))
    seen = Observation()
    marked = _by_window(own, keys).withColumns({"_again": again, "_null": _nulls(keys)})
    counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.max("_null").alias("nulls"), F.max("_again").alias("again"), F.count_if(F.col("pos") == 0).alias("entities"), F.max("size").alias("largest"))
    ranks = Scratch(own.sparkSession).save(counted.drop("_again", "_null"), "ranks")
    found = seen.get
    _refuse(keys, found.get("rows") or 0, found.get("nulls"), found.get("again"))
    return Source(keys, ranks, Shape(found["rows"], found["entities"], found["rows"] if keys.entity is None else 0, found["largest"]))


def _refuse(keys: Keys, rows: int, nulls, again) -> None:
    if not rows:
        raise ValueError("X is empty")
    if nulls:
        raise ValueError(f"null in key columns {keys.columns}")
    if again:
        raise ValueError(f"repeated keys in {keys.columns}")


def check_keys(df: DataFrame, keys: Keys) -> Shape:
    """Raises ValueError for an empty table, null keys or repeated keys: folds of such rows aren't defined. One pass over the keys."""
    keys.check(df)
    per_key = df.groupBy(*keys.columns).agg(F.count("*").alias("n"))
    distinct = [F.count_distinct(keys.time).alias("times"), F.count_distinct(keys.entity).alias("entities")] if keys.entity is not None else []
    seen = per_key.agg(F.count("*").alias("rows"), F.max(_nulls(keys)).alias("nulls"), F.max("n").alias("most"), *distinct).first()
    _refuse(keys, seen["rows"], seen["nulls"], (seen["most"] or 0) > 1)
    if keys.entity is None:
        return Shape(seen["rows"], 1, seen["rows"], seen["rows"])
    # An entity has a row a time at most; only where that leaves it open are its rows counted.
    largest = seen["rows"] if keys.tiebreak else min(seen["rows"], seen["times"])
    if largest > SERIES_IN_ONE_TASK:
        largest = df.groupBy(keys.entity).count().agg(F.max("count")).first()[0]
    return Shape(seen["rows"], seen["entities"], seen["times"], largest)
