"""From bounds to rows: which key is train or test in which fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.bounds import LITERAL_FOLDS
from chronofold.operators.keys import Keys, Shape
from chronofold.scratch import Scratch

#: Bounds of so many (fold, entity) pairs at most are broadcast; more are joined by entity.
BROADCAST_BOUNDS = 100_000
#: Blocks of folds that are broadcast at most; more are joined by block.
BROADCAST_BLOCKS = 500_000


def _joined_with(df: DataFrame, small: bool) -> DataFrame:
    """``df`` as a side of a join: broadcast if it is ``small``, and else never. Spark goes by the bytes of a saved table, of which regular bounds take less than one a row."""
    return F.broadcast(df) if small else df.hint("merge")


def assignment(ranks: DataFrame, bounds: DataFrame, keys: Keys, folds: int, shape: Shape, spans: int = 0, role: str | None = None) -> DataFrame:
    """fold_id, role ('train' or 'test'), all columns of ``ranks`` but size: a row for each fold and role that a key has (both, in sample; as often as it is named, at repeated anchors).

    Up to ``LITERAL_FOLDS`` folds (``spans``: test rows of one fold, where a test is a set) stand in one array that meets each row of their entity once;
    more are met block by block, see ``_by_blocks``. ``role``: only rows of this role, without making the others.
    """
    small = folds * shape.entities <= BROADCAST_BOUNDS
    columns = [c for c in ranks.columns if c not in ("pos", "size")]
    if max(folds, spans) > LITERAL_FOLDS:
        return _by_blocks(ranks, bounds, keys, folds, shape, role).select("fold_id", "role", *columns, "pos")
    names = ["fold_id", "test_lo", "test_hi", "points", "train_lo", "train_hi"]
    if keys.entity is None:  # as many rows as folds: they become a literal
        kinds = bounds.schema
        rows = sorted(bounds.select(*names).collect(), key=lambda r: r["fold_id"])
        folds = [F.struct(*(F.lit(r[c]).cast(kinds[c].dataType).alias(c) for c in names)) for r in rows]
        met = ranks.withColumn("_folds", F.array(*folds))
    else:
        per = bounds.groupBy(keys.entity).agg(F.collect_list(F.struct(*names)).alias("_folds"))
        met = ranks.join(_joined_with(per, small), keys.entity)
    pos, none = F.col("pos"), F.array().cast("array<string>")

    def roles(b):
        train = none if role == "test" else F.when((pos >= b["train_lo"]) & (pos < b["train_hi"]), F.array(F.lit("train"))).otherwise(none)
        times = F.when(b["points"].isNotNull(), F.size(F.filter(b["points"], lambda p: p == pos))).otherwise(((pos >= b["test_lo"]) & (pos < b["test_hi"])).cast("int"))
        test = none if role == "train" else F.array_repeat(F.lit("test"), times)
        return F.transform(F.concat(train, test), lambda r: F.struct(b["fold_id"].alias("fold_id"), r.alias("role")))

    out = met.select(*columns, "pos", F.explode(F.flatten(F.transform("_folds", roles))).alias("_f"))
    return out.select("_f.fold_id", "_f.role", *columns, "pos")


def _by_blocks(ranks: DataFrame, bounds: DataFrame, keys: Keys, folds: int, shape: Shape, role: str | None) -> DataFrame:
    """A row meets the folds whose range holds it, by an equi-join on blocks of positions.

    Blocks of level l have ``width`` * 2^l positions. A range is cut into the fewest whole blocks, of a few levels, and at most two parts of
    blocks of the lowest level at its ends, where positions are compared. A row has one block a level. With ``width`` = rows / folds
    there are about log2(folds) levels, so n rows and k folds cost (n + k) log k besides the output, and a fold lies in one or two blocks of the ends.
    """
    entity = [keys.entity] if keys.entity else []
    sides = [F.struct(F.lit(r).alias("role"), F.col(f"{r}_lo").alias("lo"), F.col(f"{r}_hi").alias("hi")) for r in ("train", "test") if role in (None, r)]
    single = F.transform(F.coalesce("points", F.array().cast("array<long>")), lambda p: F.struct(F.lit("test").alias("role"), p.alias("lo"), (p + 1).alias("hi")))
    ranges = F.filter(F.array(*sides), lambda s: (s["hi"] > s["lo"]) & (F.col("points").isNull() | (s["role"] == "train")))
    spans = bounds.select("fold_id", *entity, F.explode(F.concat(ranges, single) if role != "train" else ranges).alias("_s")).select("fold_id", *entity, "_s.role", "_s.lo", "_s.hi")
    spans = Scratch(ranks.sparkSession).save(spans, "ranges")
    longest, n = spans.agg(F.max(F.col("hi") - F.col("lo")), F.count("*")).first()
    low = max(0, (shape.largest // max(1, n // max(1, shape.entities))).bit_length() - 1)  # width = 2^low
    levels = max(1, (int(longest or 1) >> low).bit_length())
    lo, hi = F.expr(f"shiftright(lo + {(1 << low) - 1}L, {low})"), F.expr(f"shiftright(hi, {low})")
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), _blocks_of_level))
    ends = F.array_distinct(F.filter(F.array(F.when(F.expr(f"pmod(lo, {1 << low}L) > 0"), F.expr(f"shiftright(lo, {low})")), F.when(F.expr(f"pmod(hi, {1 << low}L) > 0"), F.col("_hi"))), lambda b: b.isNotNull()))
    edge = F.transform(ends, lambda b: F.struct(F.lit(-1).alias("level"), b.alias("block")))
    blocks = spans.withColumns({"_lo": lo, "_hi": hi}).select("fold_id", *entity, "role", "lo", "hi", F.explode(F.concat(whole, edge)).alias("_b"))
    blocks = blocks.select("fold_id", *entity, "role", "lo", "hi", "_b.level", "_b.block")
    own = F.expr(f"shiftright(pos, {low})")
    at = F.transform(F.sequence(F.lit(-1), F.lit(levels - 1)), lambda v: F.struct(v.alias("level"), F.call_function("shiftright", own, F.greatest(v, F.lit(0))).alias("block")))
    rows = ranks.drop("size").withColumn("_b", F.explode(at)).withColumns({"level": F.col("_b.level"), "block": F.col("_b.block")}).drop("_b")
    return rows.join(_joined_with(blocks, n * (2 * levels + 2) <= BROADCAST_BLOCKS), [*entity, "level", "block"]).where("level >= 0 or pos >= lo and pos < hi")


def _blocks_of_level(level):
    """The blocks of a level, at most one at either end, of the whole blocks [_lo, _hi) of the lowest level."""
    lo = F.call_function("shiftright", F.col("_lo") + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
    hi = F.call_function("shiftright", F.col("_hi"), level)
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    first = F.when(odd(lo) & (lo < hi), F.struct(level.alias("level"), lo.alias("block")))
    last = F.when(odd(hi) & (lo + F.pmod(lo, F.lit(2)) < hi), F.struct(level.alias("level"), (hi - 1).alias("block")))
    return F.filter(F.array(first, last), lambda b: b.isNotNull())


def time_ranges(ranks: DataFrame, bounds: DataFrame, keys: Keys, pairs: int = 0) -> dict[tuple[int, str], Column]:
    """For each fold and role a condition on the time column with literals: from the first to the last time of its rows in all entities. Roles without rows have none.

    A row a fold and role comes to the driver, as numbers or texts that name a time exactly whatever the time zone.
    """
    kind = ranks.schema[keys.time].dataType.simpleString()
    out = F.unix_micros if kind == "timestamp" else lambda c: F.col(c).cast("string")
    back = (lambda v: F.timestamp_micros(F.lit(v))) if kind == "timestamp" else lambda v: F.lit(v).cast(kind)
    ends = time_bounds(ranks, bounds, keys, pairs).groupBy("fold_id", "role").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = ends.select("fold_id", "role", out("first").alias("first"), out("last").alias("last")).collect()
    return {(r["fold_id"], r["role"]): F.col(keys.time).between(back(r["first"]), back(r["last"])) for r in found}


def time_bounds(ranks: DataFrame, bounds: DataFrame, keys: Keys, pairs: int = 0) -> DataFrame:
    """Bounds as times, for filters that reach the scan of the raw table: fold_id, [entity], role, first and last time (points, where a test is a set, stay positions). ``pairs``: (fold, entity) pairs of the bounds, if they are known."""
    ends = [("test", F.col("test_lo"), F.col("test_hi")), ("train", F.col("train_lo"), F.col("train_hi"))]
    rows = bounds.select("*", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), lo.alias("lo"), hi.alias("hi")) for r, lo, hi in ends))).alias("_e")).where("_e.hi > _e.lo")
    entity = [keys.entity] if keys.entity else []
    rows = rows.select("fold_id", *entity, "_e.role", "_e.lo", "_e.hi")
    at = rows.select("*", F.explode(F.array("lo", F.col("hi") - 1)).alias("pos"))
    if not entity or pairs > BROADCAST_BOUNDS:
        at = _joined_with(at, not entity)
    met = ranks.join(at, [*entity, "pos"])
    return met.groupBy("fold_id", *entity, "role").agg(F.min(keys.time).alias("first"), F.max(keys.time).alias("last"))
