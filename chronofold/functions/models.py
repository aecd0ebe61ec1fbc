"""Small models fitted per fold, and per entity, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.prefix import fold_sums
from chronofold.operators.keys import Source
from chronofold.operators.splitters import TemporalSplit


def _sides(data: DataFrame, assigned: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    rows = data.join(assigned.select("fold_id", "role", *keys), list(keys))
    return rows.where("role = 'train'"), rows.where("role = 'test'").drop("role")


def ratio_model(data: DataFrame, assigned: DataFrame, keys: Sequence[str], y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Test rows with ``prediction``: x times the mean of y / x over the train rows of the fold (and of each ``by``). Rows with x = 0 don't count."""
    train, test = _sides(data, assigned, keys)
    group = ["fold_id", *by]
    coefficients = train.groupBy(*group).agg(F.avg(F.col(y) / F.nullif(F.col(x), F.lit(0))).alias("coefficient"))
    return test.join(coefficients, group).withColumn("prediction", F.col(x) * F.col("coefficient")).drop("coefficient")


def ratio_by_sums(splitter: TemporalSplit, source: Source, y: str, x: str) -> DataFrame:
    """``ratio_model`` by fold and entity over a saved source: means are differences of running sums, so no train row is copied."""
    group = ["fold_id", *([source.keys.entity] if source.keys.entity else [])]
    ratio = F.col(y) / F.nullif(F.col(x), F.lit(0))
    sums = fold_sums(splitter, source, {"_sum": ratio, "_known": F.when(ratio.isNotNull(), F.lit(1))})
    coefficients = sums.select(*group, (F.col("_sum") / F.nullif(F.col("_known"), F.lit(0))).alias("_coefficient"))
    test = splitter.assign_rows(source, role="test").drop("role")
    return test.join(coefficients, group).withColumn("prediction", F.col(x) * F.col("_coefficient")).drop("_coefficient")


def linear_model(data: DataFrame, assigned: DataFrame, keys: Sequence[str], y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Test rows with ``prediction`` of the least-squares line of y on x over the train rows."""
    train, test = _sides(data, assigned, keys)
    group = ["fold_id", *by]
    lines = train.groupBy(*group).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("_slope"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("_intercept"))
    return test.join(lines, group).withColumn("prediction", F.col("_intercept") + F.col("_slope") * F.col(x)).drop("_slope", "_intercept")
