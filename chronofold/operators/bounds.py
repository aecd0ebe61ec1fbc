"""Folds as rows of bounds.

A fold is (fold_id, entity, test_lo, test_hi, points, train_lo, train_hi): half-open ranges of positions within the entity.
``points`` is null where the test is a range; an in-sample test at several anchors is the list of its positions instead.
There is a row a fold and entity that has test rows, so bounds stay small next to the data they describe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators.keys import SERIES_IN_ONE_TASK, Keys, Shape, summed_before
from chronofold.plans.spec import SplitSpec
from chronofold.scratch import Scratch

#: Folds of a series that become literals of a plan at most; more are a table.
LITERAL_FOLDS = 32


def fold_bounds(ranks: DataFrame, keys: Keys, spec: SplitSpec, shape: Shape) -> tuple[DataFrame, int]:
    """Bounds and number of folds. ``ranks``: the keys with pos and size."""
    tests, folds = _tests(ranks, keys, spec, shape)
    bounds = _with_train(tests, keys, spec)
    if spec.missing == "raise" and keys.entity is not None:
        bounds = _with_all(bounds, folds * shape.entities)
    return bounds, folds


def _tests(ranks: DataFrame, keys: Keys, spec: SplitSpec, shape: Shape) -> tuple[DataFrame, int]:
    """fold_id, [entity], test_lo, test_hi, points, n_test; and the number of folds."""
    if keys.entity is None and spec.anchor_kind in (None, "position"):
        return _series_tests(ranks, spec, shape)
    if spec.anchor_kind is None:
        back, size = _default_starts(keys, spec, shape)
        times = _times_from_end(ranks, keys, back, spec.time_order)
        return _ranges(_first_of_time(ranks.join(F.broadcast(times), keys.time), keys), size), len(back)  # a row a fold
    many = len(spec.anchors) > 1
    size = spec.test_size or 1
    by_time = keys.entity is not None and spec.anchor_kind == "time"
    found = _resolved(ranks, keys, spec, shape)
    if spec.mode == "oos":
        if by_time:  # a fold an anchor, in the order given
            return _ranges(found, size), len(spec.anchors)
        order = W.orderBy(F.struct(*keys.columns), "fold_id")  # a row an anchor
        numbered = found.withColumn("fold_id", F.row_number().over(order) - 1)
        return _ranges(numbered, size), numbered.count()
    found = found.withColumn("fold_id", F.lit(0))
    # several times, or several resolved rows: the test is the set of those rows
    if by_time and not many:
        return _ranges(found, size), 1
    if not by_time and not many:
        return (_ranges(found, size) if keys.entity is None else _run_from(ranks, keys, found, size, shape.entities)), 1
    return _points(found, [keys.entity] if keys.entity else [], F.collect_set("pos") if by_time else F.collect_list("pos")), 1


def _points(found: DataFrame, entity: list[str], gathered: Column) -> DataFrame:
    out = found.groupBy("fold_id", *entity).agg(F.sort_array(gathered).alias("points"))
    return out.select("fold_id", *entity, F.array_min("points").alias("test_lo"), (F.array_max("points") + 1).alias("test_hi"), "points", F.size("points").cast("long").alias("n_test"))


def _series_tests(ranks: DataFrame, spec: SplitSpec, shape: Shape) -> tuple[DataFrame, int]:
    """The places of a series are known from its length: no data are read."""
    if spec.anchor_kind is None:
        back, size = _default_starts(Keys(""), spec, shape)
        starts = [shape.rows - n for n in back]
    else:
        _check_places(spec, shape)
        starts, size = sorted(int(p) for p in spec.anchors), spec.test_size or 1
    one_set = spec.mode == "is" and len(starts) > 1
    rows = [(0 if one_set else i, p, shape.rows) for i, p in enumerate(starts)]
    if len(rows) > LITERAL_FOLDS or one_set:
        found = ranks.sparkSession.createDataFrame(rows, "fold_id int, pos long, size long")
    else:  # no job is needed to read these
        found = ranks.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f'({i}, {p}L, {n}L)' for i, p, n in rows)} AS t(fold_id, pos, size)")
    return (_points(found, [], F.collect_list("pos")), 1) if one_set else (_ranges(found, size), len(starts))


def _default_starts(keys: Keys, spec: SplitSpec, shape: Shape) -> tuple[list[int], int]:
    """How many distinct times from the end the default folds' tests start (1: the last), and the test size."""
    k, n = spec.n_splits, shape.times
    if keys.entity is None:
        size = spec.test_size or n // (k + 1)
        if spec.mode == "is":
            if size < 1:
                raise ValueError(f"no test rows: {n} samples for {k} folds")
            return [min(n, size)], size
        if k + 1 > n:
            raise ValueError(f"Cannot have number of folds={k + 1} greater than the number of samples={n}.")
        if n - k * size <= 0:
            raise ValueError(f"Too many splits={k} for number of samples={n} with test_size={size} and gap={spec.gap}.")
    else:
        size = spec.test_size or 1
        if spec.mode == "is":
            return [1], size
        if n - k * size <= 0:
            raise ValueError(f"Too many splits={k} for number of time points={n} with test_size={size} and gap={spec.gap}.")
    return [(k - i) * size for i in range(k)], size


def _times_from_end(ranks: DataFrame, keys: Keys, back: list[int], time_order: str = "chronological") -> DataFrame:
    """fold_id, time: the distinct times that stand so many places from the end (1: the last). Reads the last ``max(back)`` times only; they never leave Spark, so no time zone touches them."""
    by = [F.desc(keys.time)]
    if keys.entity is not None and time_order == "first_seen":
        times, by = ranks.groupBy(keys.time).agg(F.min(keys.entity).alias("_first")), [F.desc("_first"), *by]
    else:
        times = ranks.select(keys.time).distinct()
    at = times.orderBy(*by).limit(max(back)).withColumn("_back", F.row_number().over(W.orderBy(*by)))
    fold = F.array_position(F.array(*(F.lit(b) for b in back)), F.col("_back")) - 1
    return at.select(fold.cast("int").alias("fold_id"), keys.time).where("fold_id >= 0")


def _join_times(ranks: DataFrame, keys: Keys, times: list) -> DataFrame:
    """Rows at the times that the caller gave; fold_id is the place in the list. The list is a parameter, so its side is broadcast."""
    kind = ranks.schema[keys.time].dataType
    rows = [(i, t if not isinstance(t, str) else t) for i, t in enumerate(times)]
    spark = ranks.sparkSession
    if rows and isinstance(rows[0][1], str) and kind.simpleString() != "string":
        anchors = spark.createDataFrame(rows, "fold_id int, t string").select("fold_id", F.col("t").cast(kind).alias(keys.time))
    else:
        anchors = spark.createDataFrame([(i, _as(kind.simpleString(), t)) for i, t in rows], f"fold_id int, `{keys.time}` {kind.simpleString()}")
    return ranks.join(F.broadcast(anchors), keys.time)


def _as(kind: str, value):
    """A date for a date column and a time stamp for a time stamp column, whichever was given."""
    import datetime

    if kind == "date" and isinstance(value, datetime.datetime):
        if value != datetime.datetime.combine(value.date(), datetime.time()):
            raise ValueError(f"{value} not found in data: the time column holds dates")
        return value.date()
    if kind.startswith("timestamp") and isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime.combine(value, datetime.time())
    return str(value) if kind == "string" and not isinstance(value, str) else value


def _resolved(ranks: DataFrame, keys: Keys, spec: SplitSpec, shape: Shape) -> DataFrame:
    """The rows that the anchors name (once an anchor), with the anchor's place in the list as fold_id."""
    anchors, kind = list(spec.anchors), spec.anchor_kind
    spark = ranks.sparkSession
    if kind == "position":
        _check_places(spec, shape)
        wanted = F.broadcast(spark.createDataFrame([(i, int(p)) for i, p in enumerate(anchors)], "fold_id int, _place long"))
        return _global(ranks, keys, shape.entities).join(wanted, "_place").drop("_place")
    if kind == "pair":
        if keys.entity is None:
            raise ValueError("(entity, time) anchors need panel data")
        e, t = (ranks.schema[c].dataType.simpleString() for c in (keys.entity, keys.time))
        rows = [(i, a[0], _as(t, a[1]) if not isinstance(a[1], str) else a[1]) for i, a in enumerate(anchors)]
        given = spark.createDataFrame(rows, f"fold_id int, `{keys.entity}` {e}, `{keys.time}` {'string' if isinstance(rows[0][2], str) else t}")
        found = ranks.join(F.broadcast(given.withColumn(keys.time, F.col(keys.time).cast(ranks.schema[keys.time].dataType))), [keys.entity, keys.time])
    else:
        found = _join_times(ranks, keys, anchors)
    found = _first_of_time(found, keys)
    seen = {r[0] for r in found.select("fold_id").distinct().collect()}  # one a anchor
    lost = [a for i, a in enumerate(anchors) if i not in seen]
    if lost:
        raise ValueError(f"{', '.join(map(str, lost))} not found in {'panel ' if keys.entity else ''}data")
    return found


def _check_places(spec: SplitSpec, shape: Shape) -> None:
    if max(spec.anchors) >= shape.rows:
        raise ValueError("test_indices contain indices beyond data length")
    if min(spec.anchors) < 0:
        raise ValueError("test_indices contain negative indices")


def _first_of_time(found: DataFrame, keys: Keys) -> DataFrame:
    """Where times repeat, a time stands for its first row in the entity."""
    if not keys.tiebreak:
        return found
    others = [c for c in ("_place", *keys.tiebreak) if c in found.columns]
    return found.groupBy("fold_id", *keys.within, keys.time).agg(F.min("pos").alias("pos"), F.first("size").alias("size"), *(F.min_by(c, "pos").alias(c) for c in others))


def _global(ranks: DataFrame, keys: Keys, entities: int) -> DataFrame:
    """Adds the position over all entities in their order: sizes of the entities before, summed up (many entities: by ranges), plus pos."""
    if keys.entity is None:
        return ranks.withColumn("_place", F.col("pos"))
    sizes = ranks.where("pos = 0").select(keys.entity, "size")
    before = summed_before(sizes, [keys.entity], "size", "_before", entities > SERIES_IN_ONE_TASK).drop("size")
    return ranks.join(before, keys.entity).withColumn("_place", F.col("_before") + F.col("pos")).drop("_before")


def _ranges(found: DataFrame, size: int) -> DataFrame:
    """Tests of ``size`` rows from each found row, cut at the entity's end."""
    drop = [c for c in found.columns if c in ("pos", "size")]
    hi = F.least(F.col("pos") + size, F.col("size"))
    return found.withColumn("test_lo", F.col("pos")).withColumn("test_hi", hi).withColumn("points", F.lit(None).cast("array<long>")).withColumn("n_test", hi - F.col("pos")).drop(*drop)


def _run_from(ranks: DataFrame, keys: Keys, found: DataFrame, size: int, entities: int) -> DataFrame:
    """One test of ``size`` rows of the whole panel from one found row, on into the entities that follow."""
    place = _global(ranks, keys, entities).join(F.broadcast(found.select(*keys.columns)), keys.columns).first()["_place"]
    each = _global(ranks.where("pos = 0"), keys, entities).select(keys.entity, (F.lit(place) - F.col("_place")).alias("_from"), "size")
    lo, hi = F.greatest(F.col("_from"), F.lit(0)), F.least(F.col("_from") + size, F.col("size"))
    ranges = each.select(F.lit(0).alias("fold_id"), keys.entity, lo.alias("test_lo"), hi.alias("test_hi")).where("test_hi > test_lo")
    return ranges.withColumn("points", F.lit(None).cast("array<long>")).withColumn("n_test", F.col("test_hi") - F.col("test_lo"))


def _with_train(tests: DataFrame, keys: Keys, spec: SplitSpec) -> DataFrame:
    m: int | None = spec.max_train_size
    if spec.mode == "oos":
        end: Column = F.greatest(F.col("test_lo") - spec.gap, F.lit(0))
        start: Column = F.greatest(end - m, F.lit(0)) if m else F.lit(0)
    else:
        end = F.col("test_hi")
        start = F.lit(0) if m is None else F.greatest(end - F.greatest(F.lit(m), F.col("n_test")), F.lit(0))
    entity = [keys.entity] if keys.entity else []
    return tests.select(F.col("fold_id").cast("int").alias("fold_id"), *entity, "test_lo", "test_hi", "points", start.cast("long").alias("train_lo"), end.cast("long").alias("train_hi"))


def _with_all(bounds: DataFrame, least: int) -> DataFrame:
    """The bounds, written and counted on the way: there is a row a fold and entity, if each entity has test rows in each fold."""
    seen = Observation()
    saved = Scratch(bounds.sparkSession).save(bounds.observe(seen, F.count(F.lit(1)).alias("n")), "bounds")
    if (seen.get.get("n") or 0) < least:
        raise ValueError("Cannot find test indices for the group: an entity has no test rows in some fold")
    return saved
