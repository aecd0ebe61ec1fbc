"""Seeded synthetic series and panels, built by Spark expressions from ids: the same rows however they are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def _normal(seed: int, *keys: Column) -> Column:
    u, v = F.greatest(_uniform(seed, *keys), F.lit(1e-300)), _uniform(seed + 1, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def _autoregressive(shocks: Column, phi: float) -> Column:
    """x[i] = phi x[i-1] + shock[i] over an array."""
    step = lambda acc, s: F.array_append(acc, F.coalesce(F.element_at(acc, -1), F.lit(0.0)) * phi + s)
    return F.aggregate(shocks, F.array().cast("array<double>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s)))


def synthetic_series(spark: SparkSession, periods: int = 180, start: str = "2008-01-01", *, slope: float = 0.5, season: float = 10.0, phi: float = 0.7, noise: float = 2.0, outliers: float = 0.02, seed: int = 42) -> DataFrame:
    """date, value: monthly, with a trend, a yearly season, an AR(1) disturbance and a few outliers."""
    i = F.sequence(F.lit(0), F.lit(periods - 1))
    shocks = F.transform(i, lambda j: noise * _normal(seed, j))
    rows = spark.range(1).select(F.posexplode(_autoregressive(shocks, phi)).alias("i", "ar"))
    value = 100 + slope * F.col("i") + season * F.sin(2 * F.pi() * F.col("i") / 12) + F.col("ar")
    spike = F.when(_uniform(seed + 7, F.col("i")) < outliers, 5 * noise * _normal(seed + 9, F.col("i"))).otherwise(0.0)
    return rows.select(F.add_months(F.lit(start).cast("date"), F.col("i")).alias("date"), (value + spike).alias("value"))


def synthetic_panel(spark: SparkSession, entities: int = 20, periods: int = 120, start: str = "2010-01-01", *, phi: float = 0.5, noise: float = 1.0, missing: float = 0.05, seed: int = 42) -> DataFrame:
    """entity, date, value, month, trend: a fixed effect an entity, shocks common to a date, own disturbances, and missing rows."""
    own = spark.range(entities).select(F.format_string("entity_%04d", "id").alias("entity"))
    i = F.sequence(F.lit(0), F.lit(periods - 1))
    shocks = F.transform(i, lambda j: noise * _normal(seed, F.col("entity"), j))
    rows = own.select("entity", F.posexplode(_autoregressive(shocks, phi)).alias("i", "ar"))
    common = 3 * _normal(seed + 20, F.col("i"))
    effect = 10 * _normal(seed + 30, F.col("entity"))
    date = F.add_months(F.lit(start).cast("date"), F.col("i"))
    out = rows.select("entity", date.alias("date"), (50 + effect + common + 0.1 * F.col("i") + F.col("ar")).alias("value"), F.month(date).alias("month"), F.col("i").cast("long").alias("trend"))
    return out.where(_uniform(seed + 40, F.col("entity"), F.col("trend")) >= missing)
