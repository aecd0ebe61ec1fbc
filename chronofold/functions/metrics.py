"""Errors of forecasts and descriptions of folds, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.features import over_neighbours


def rmse(actual: str, predicted: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), 2)))


def mae(actual: str, predicted: str) -> Column:
    return F.avg(F.abs(F.col(actual) - F.col(predicted)))


def mape(actual: str, predicted: str) -> Column:
    """Per cent; rows whose actual value is 0 don't count."""
    return F.avg(F.abs((F.col(actual) - F.col(predicted)) / F.nullif(F.col(actual), F.lit(0)))) * 100


def direction_accuracy(df: DataFrame, actual: str, predicted: str, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose change from the row before has the same sign in both; the first row has no change and counts as a miss. A fold too large for one task is compared by ranges."""
    group = F.struct(*by).alias("_by") if by else F.lit(0).alias("_by")
    rows = df.select(*by, F.col(time).alias("_time"), F.col(actual).alias("_actual"), F.col(predicted).alias("_predicted"), group)
    before = {"_actual": "_actual_before", "_predicted": "_predicted_before"}
    df = over_neighbours(rows, lambda w: {name: F.lag(c).over(w) for c, name in before.items()}, 1, 0, "_time", "_by")
    same = F.signum(F.col("_actual") - F.col("_actual_before")) == F.signum(F.col("_predicted") - F.col("_predicted_before"))
    return df.withColumn("_hit", F.coalesce(same, F.lit(False)).cast("int")).groupBy(*by).agg(F.avg("_hit").alias("direction_accuracy"))


def fold_summary(per_fold: DataFrame, metric: str) -> DataFrame:
    """Number, mean and both standard deviations of a metric over folds."""
    return per_fold.agg(F.count(metric).alias("folds"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std_pop"), F.stddev_samp(metric).alias("std_samp"))


def describe_folds(assigned: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """A row a fold (and what else ``by`` names): sizes, first and last times of both roles, days from train to test."""
    def of(role: str) -> Column:
        return F.when(F.col("role") == role, F.col(time))

    out = assigned.groupBy("fold_id", *by).agg(
        F.count(of("train")).alias("train_size"), F.count(of("test")).alias("test_size"),
        F.min(of("train")).alias("train_first"), F.max(of("train")).alias("train_last"), F.min(of("test")).alias("test_first"), F.max(of("test")).alias("test_last"),
    )
    return out.withColumn("gap_days", F.datediff("test_first", "train_last"))


def split_statistics(assigned: DataFrame, entity: str | None = None) -> DataFrame:
    """One row: number of folds, mean sizes of train and test, distinct entities."""
    folds = F.count_distinct("fold_id")
    mean_size = lambda role: F.count_if(F.col("role") == role) / folds
    entities = [] if entity is None else [F.count_distinct(entity).alias("entities")]
    return assigned.agg(folds.alias("folds"), mean_size("train").alias("mean_train_size"), mean_size("test").alias("mean_test_size"), *entities)


def outside_train(assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Test rows that aren't train rows of their fold: none, in sample."""
    test, train = (assigned.where(F.col("role") == r).select("fold_id", *keys) for r in ("test", "train"))
    return test.join(train, ["fold_id", *keys], "left_anti")


def overlap(assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are both train and test in a fold: none, out of sample."""
    test, train = (assigned.where(F.col("role") == r).select("fold_id", *keys) for r in ("test", "train"))
    return test.intersect(train)


def cross_section(df: DataFrame, value: str, time: str) -> DataFrame:
    """Mean and sample standard deviation over the entities at each time."""
    return df.groupBy(time).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
