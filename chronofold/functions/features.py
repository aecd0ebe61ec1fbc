"""Columns that forecasts are made from, as window and date expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators.keys import SERIES_IN_ONE_TASK, Keys, with_places
from chronofold.scratch import Scratch

#: Bytes that Spark may expect of a row, at most, for a panel to count as small.
ROW_BYTES = 64
#: Rows of a series, or an entity, that one task shifts, where they are spread.
ROWS_A_BLOCK = 1_000_000


def gap_for(horizon: int, delay: int) -> int:
    """A gap that keeps a forecast of so many periods, from data published so late, free of its own future."""
    if horizon < 0 or delay < 0:
        raise ValueError("horizon and delay must not be negative")
    return horizon + delay


def _within(time: str, entity: str | None) -> W:
    return W.partitionBy(*([entity] if entity else [])).orderBy(time)


def over_neighbours(df: DataFrame, made: Callable[[W], dict[str, Column]], back: int, ahead: int, time: str, entity: str | None, spread: bool | None = None) -> DataFrame:
    """Adds columns made over the window of a series or entity, which reach so many rows back and ahead.

    ``spread``: the rows are ranked by ranges and cut into blocks of ``ROWS_A_BLOCK``, each with the neighbours it needs, so that
    no series or entity has to fit one task. By default a series is spread where it is too long for one, and of a panel those entities that are.
    """
    if spread is None and entity is not None:
        return _by_weight(df, entity, lambda some, heavy: over_neighbours(some, made, back, ahead, time, entity, heavy))
    if spread is None:
        spread = df.count() > SERIES_IN_ONE_TASK
    if not spread:
        return df.withColumns(made(_within(time, entity)))
    rows = with_places(df, Keys(time, entity)).withColumnRenamed("pos", "_pos").drop("size")
    block = lambda c: F.floor(c / ROWS_A_BLOCK)
    near = rows.withColumn("_block", F.explode(F.sequence(block(F.col("_pos") - ahead), block(F.col("_pos") + back))))
    out = near.withColumns(made(W.partitionBy(*([entity] if entity else []), "_block").orderBy("_pos")))
    return out.where(F.col("_block") == block(F.col("_pos"))).drop("_pos", "_block")


def _by_weight(df: DataFrame, entity: str, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``work`` on the rows of the entities that are too large for one task (True), which are counted, and on all others (False), as one relation.

    A source that Spark expects to be small isn't counted. Large entities are few, at most rows / ``SERIES_IN_ONE_TASK``, so their list is broadcast.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ROW_BYTES * SERIES_IN_ONE_TASK:
        return work(df, False)
    large = df.groupBy(F.struct(entity).alias("_large")).count().where(F.col("count") > SERIES_IN_ONE_TASK).select("_large")
    large = Scratch(df.sparkSession).save(large, "large-entities")
    if not large.limit(1).count():
        return work(df, False)
    same = F.struct(F.col(entity)).eqNullSafe(F.col("_large"))
    return work(df.join(F.broadcast(large), same, "left_semi"), True).unionByName(work(df.join(F.broadcast(large), same, "left_anti"), False))


def align_horizon(df: DataFrame, target: str, horizon: int, time: str, entity: str | None = None, to: str = "target_ahead", spread: bool | None = None) -> DataFrame:
    """Adds the target of ``horizon`` rows later; rows whose target lies past the end go."""
    made = lambda w: {to: F.lead(target, horizon).over(w), "_last": F.lead(F.lit(1), horizon).over(w) if horizon else F.lit(1)}
    return over_neighbours(df, made, 0, horizon, time, entity, spread).where("_last is not null").drop("_last")


def lag_features(df: DataFrame, column: str, lags: Sequence[int], time: str, entity: str | None = None, spread: bool | None = None) -> DataFrame:
    """Adds <column>_lag_<n>: the value n rows earlier."""
    made = lambda w: {f"{column}_lag_{n}": F.lag(column, n).over(w) for n in lags}
    return over_neighbours(df, made, max([0, *lags]), max([0, *(-n for n in lags)]), time, entity, spread)


def publication_delay(df: DataFrame, columns: Sequence[str], delay: int, time: str, entity: str | None = None, spread: bool | None = None) -> DataFrame:
    """Each column as it was known: its value ``delay`` rows earlier."""
    made = lambda w: {c: F.lag(c, delay).over(w) for c in columns}
    return over_neighbours(df, made, delay, 0, time, entity, spread)


def calendar_features(df: DataFrame, time: str) -> DataFrame:
    """Adds day_of_week (Monday 0), month and day_of_year."""
    return df.withColumns({"day_of_week": F.weekday(time), "month": F.month(time), "day_of_year": F.dayofyear(time)})


def trend(df: DataFrame, time: str, entity: str | None = None, spread: bool | None = None) -> DataFrame:
    """Adds ``trend``: 0, 1, ... along time. ``spread`` as above."""
    if spread is None and entity is not None:
        return _by_weight(df, entity, lambda some, heavy: trend(some, time, entity, heavy))
    if spread or (spread is None and entity is None and df.count() > SERIES_IN_ONE_TASK):
        return with_places(df, Keys(time, entity)).drop("size").withColumnRenamed("pos", "trend")
    return df.withColumn("trend", F.row_number().over(_within(time, entity)).cast("long") - 1)


def entities(df: DataFrame, entity: str) -> DataFrame:
    """The distinct entities."""
    return df.select(entity).distinct()


def entity_section(df: DataFrame, entity: str, value: object) -> DataFrame:
    """The rows of one entity, without the entity column."""
    return df.where(F.col(entity).eqNullSafe(F.lit(value))).drop(entity)


def time_section(df: DataFrame, time: str, value: object) -> DataFrame:
    """The rows of all entities at one time, without the time column."""
    return df.where(F.col(time).eqNullSafe(F.lit(value).cast(df.schema[time].dataType))).drop(time)


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls in the columns (all, if none are named)."""
    return df.dropna(subset=list(columns) if columns else None)


def share_known(column: str) -> Column:
    """Per cent of the rows that hold a value."""
    return F.count(column) / F.count("*") * 100
