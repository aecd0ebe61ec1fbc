"""Sums over the train or test rows of folds as differences of running sums.

Running sums along the positions of a series or entity are made once, and a fold's sum is their difference at its two ends. So k folds
over n rows cost n + k, however far their trains reach back, and no train row is copied for a fold.

Sums of doubles that cancel lose digits: measures should not be far from zero on average (``centred`` sees to it), and a difference
is as exact as the running sum of the whole entity, to about 1e-16 of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators.assign import BROADCAST_BOUNDS
from chronofold.operators.keys import SERIES_IN_ONE_TASK, Source
from chronofold.operators.splitters import TemporalSplit

#: Rows of an entity that one task sums up, where an entity is too large for one.
ROWS_A_BLOCK = 1_000_000


def data_of(source: Source) -> DataFrame:
    """The keys, pos and all other columns of a saved source."""
    rows = source.ranks
    return rows.select(*source.keys.columns, "pos", "_data.*") if "_data" in rows.columns else rows.drop("size")


def running_sums(rows: DataFrame, names: Sequence[str], entity: str | None, largest: int) -> DataFrame:
    """The named columns summed up along ``pos``, nulls as zeros. Entities too large for one task are summed in blocks whose totals are summed first."""
    own = [entity] if entity else []
    total = lambda c, w: F.sum(F.coalesce(F.col(c), F.lit(0))).over(w)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    if largest <= SERIES_IN_ONE_TASK:
        return rows.withColumns({c: total(c, upto(W.partitionBy(*own).orderBy("pos"))) for c in names})
    blocked = rows.withColumn("_block", F.floor(F.col("pos") / ROWS_A_BLOCK))
    totals = blocked.groupBy(*own, "_block").agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names))
    over = upto(W.partitionBy(*own).orderBy("_block"))
    before = totals.select(*own, "_block", *((F.sum(c).over(over) - F.col(c)).alias(f"_before_{c}") for c in names))
    inside = upto(W.partitionBy(*own, "_block").orderBy("pos"))
    summed = blocked.withColumns({c: total(c, inside) for c in names}).join(before, [*own, "_block"])
    return summed.withColumns({c: F.col(c) + F.col(f"_before_{c}") for c in names}).drop("_block", *(f"_before_{c}" for c in names))


def fold_sums(splitter: TemporalSplit, source: Source, measures: Mapping[str, Column], role: str = "train", pooled: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """fold_id, [entity], n and the sum of each measure over the fold's rows of the role; ``pooled``: over all entities. A fold (and entity) without such rows has none.

    Measures are expressions of the columns of the source (or of ``rows``, its rows with more columns); a null counts as zero. n is the number of rows.
    """
    keys, bounds = source.keys, splitter.bounds(source)
    entity = [keys.entity] if keys.entity else []
    lo, hi = F.col(f"{role}_lo"), F.col(f"{role}_hi")
    ranges = F.array(F.struct(lo.alias("lo"), hi.alias("hi")))
    if role == "test":  # a set of rows: each is a range of its own
        ranges = F.when(F.col("points").isNull(), ranges).otherwise(F.transform("points", lambda p: F.struct(p.alias("lo"), (p + 1).alias("hi"))))
    spans = bounds.select("fold_id", *entity, F.explode(ranges).alias("_r")).where("_r.hi > _r.lo")
    ends = F.array(F.struct((F.col("_r.lo") - 1).alias("pos"), F.lit(-1).alias("sign")), F.struct((F.col("_r.hi") - 1).alias("pos"), F.lit(1).alias("sign")))
    ends = spans.select("fold_id", *entity, F.explode(ends).alias("_e")).select("fold_id", *entity, "_e.pos", "_e.sign").where("pos >= 0")
    names = list(measures)
    rows = (data_of(source) if rows is None else rows).select(*entity, "pos", *(measures[c].alias(c) for c in names))
    sums = running_sums(rows, names, keys.entity, source.shape.largest)
    at = sums.join(F.broadcast(ends) if splitter.spec.n_splits * source.shape.entities <= BROADCAST_BOUNDS and not splitter.spec.anchors else ends, [*entity, "pos"])
    by = ["fold_id", *([] if pooled else entity)]
    return at.groupBy(*by).agg(F.sum(F.col("sign") * (F.col("pos") + 1)).alias("n"), *(F.sum(F.col("sign") * F.col(c)).alias(c) for c in names))


def centred(source: Source, columns: Sequence[str]) -> DataFrame:
    """The rows of the source with ``_m_<column>``, the mean of the column in the series or entity, and ``_c_<column>``, the column as a double less that, so that sums of squares and products keep their digits."""
    rows, keys = data_of(source), source.keys
    means = [F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in columns]
    if keys.entity is None:
        rows = rows.withColumns({f"_m_{c}": F.lit(m).cast("double") for c, m in zip(columns, rows.agg(*means).first(), strict=True)})
    else:
        rows = rows.join(rows.groupBy(keys.entity).agg(*means), keys.entity)
    return rows.withColumns({f"_c_{c}": F.col(c).cast("double") - F.col(f"_m_{c}") for c in columns})
