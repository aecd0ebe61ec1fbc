"""Hard-negative mining by a Voronoi-partitioned distributed join.

Scores are inner products, which order rows as distances do once each row x gets one more component, sqrt(M^2 - |x|^2) with M
the largest norm, and each anchor a zero there. Pivots, fitted on a bounded sample, divide this space into cells, and every
row and anchor goes to its nearest pivot. Two joins follow, first for an anchor's positives, then for its negatives:

* A cell of anchors knows its radius and the distances that matter to it. For the positives these end at a distance within
  which each of its labels surely has enough rows, by the nearest rows of every cell and label. For the negatives they are a
  shell: those of the scores that the anchors' positives allow.
* The triangle inequality bounds the distance between a row and a cell of anchors by the distances of both to their
  pivots. A row is copied to those groups of anchors (near cells together, a large one divided) whose distances it may have.
* A group's rows are dealt to several tasks, each with all anchors of the group. Rows stream past the anchors, scores are exact
  integers, and each task keeps the best of each anchor, which a window merges.

What the driver sees are the sample and a few numbers a pivot (``PIVOTS`` at most). Memory of a task depends on ``GROUP`` and not on the
tables. In vectors without clusters nearly every row may serve every group; the result doesn't depend on that.

Defined cases: rows with a null label or vec_id, a null vector, or a null or non-finite component take no part; components are
whole numbers, and one or a score beyond a long is an error; a shorter vector ends in zeros; repeated rows are candidates of their own, and
equal rows of one anchor id are one anchor; rows under an anchor's id are not its positives; different rows under one anchor id are anchors of
their own; fewer positives or negatives than asked for give fewer rows; a positive with a negative score allows no negative; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm import textops, topk
from chronofold.scratch import Scratch

#: Pivots at most, rows a pivot at least, and the sample that they are fitted on: rows, and bytes of it.
PIVOTS, ROWS_A_PIVOT = 128, 1024
SAMPLE, SAMPLE_BYTES = 1024, 16 << 20
#: Anchors of a group, about, and rows of a task that meets it at least and for each anchor.
GROUP, TASK_ROWS, ROWS_AN_ANCHOR = 8192, 2048, 16
#: Scores that a task computes at a time.
BLOCK_SCORES = 1 << 21
_ROW = "vec_id long, label long, weights array<long>"


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding -> vec_id, label, weights: floor(256 x); without the rows that take no part."""
    named = topk.quantised(vectors.select(F.struct("vec_id", F.col("label").cast("long").alias("label")).alias("vec_id"), "embedding"))
    return named.select("vec_id.vec_id", "vec_id.label", "weights").where("vec_id is not null and label is not null")


class _Space:
    """Pivots in the augmented space, in an order in which near ones stand together."""

    def __init__(self, sample: np.ndarray, squares: float, n: int) -> None:
        self.squares = squares
        self.slack = 4e-6 * (np.sqrt(squares) + 1)  # more than the rounding of any distance here
        points = self.augmented(sample)
        rng = np.random.default_rng(0)
        pivots = points[rng.choice(len(points), min(n, len(points)), replace=False)]
        for _ in range(6):
            nearest = self._squared(points, pivots).argmin(axis=1)
            pivots = np.array([points[nearest == i].mean(axis=0) if (nearest == i).any() else p for i, p in enumerate(pivots)])
        self.pivots = pivots[topk._near_together(pivots, 1)]
        self.apart = np.sqrt(self._squared(self.pivots, self.pivots))

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([rows, np.sqrt(np.maximum(self.squares - (rows**2).sum(axis=1), 0))])

    @staticmethod
    def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)

    def nearest(self, rows: np.ndarray, anchors: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pivot of each row and the distance to it. A row longer than the pivots is cut for this: its distance is then that to the pivot's space."""
        pivots = self.pivots
        points = np.column_stack([rows, np.zeros(len(rows))]) if anchors else self.augmented(rows)
        if points.shape[1] != pivots.shape[1]:
            wide = max(points.shape[1], pivots.shape[1]) - 1
            points, pivots = (np.column_stack([topk._widened(x[:, :-1], wide), x[:, -1]]) for x in (points, pivots))
        squared = self._squared(points, pivots)
        at = squared.argmin(axis=1)
        return at, np.sqrt(squared[np.arange(len(rows)), at])


def _space(rows: DataFrame) -> tuple[_Space | None, int]:
    square = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    seen = rows.agg(F.count("*").alias("n"), F.max(square).alias("squares"), F.max(F.size("weights")).alias("width")).first()
    if not seen["n"]:
        return None, 0
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, seen["width"]))))
    lot = F.xxhash64("vec_id", "weights")
    few = rows if seen["n"] < 8 * size else rows.where(F.pmod(lot, F.lit(1 << 20)) < -(-4 * size * (1 << 20) // seen["n"]))
    table = few.orderBy(lot).limit(size).select("weights").toArrow()
    if not table.num_rows:  # hardly possible: the rows of the lot are four times as many, on average
        table = rows.orderBy(lot).limit(size).select("weights").toArrow()
    sample = topk._matrix(table.column("weights").combine_chunks(), max(1, seen["width"]))
    return _Space(sample, float(seen["squares"]), max(1, min(PIVOTS, seen["n"] // ROWS_A_PIVOT))), seen["n"]


def _placed(rows: DataFrame, space: _Space, anchors: bool) -> DataFrame:
    """The rows with ``cell`` and ``dist``, their pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            cell, dist = space.nearest(topk._matrix(b.column("weights"), 0), anchors)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], names=[*b.schema.names, "cell", "dist"])

    return rows.mapInArrow(run, f"{_ROW}, cell int, dist double")


def _limits(anchors: DataFrame, placed: DataFrame, space: _Space, radius: np.ndarray, k: int) -> np.ndarray:
    """For each cell of anchors a distance within which every label of its anchors has k rows besides the anchor's own id."""
    w = W.partitionBy("cell", "label").orderBy("dist")
    nearest = placed.select("cell", "label", "vec_id", "dist").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).drop("_n")
    asked = anchors.select(F.col("cell").alias("of"), "label").distinct()
    n = len(radius)
    between = placed.sparkSession.createDataFrame([(i, j, float(radius[i] + space.apart[i, j])) for i in range(n) for j in range(n)], "of int, cell int, far double")  # PIVOTS squared at most
    bound = asked.join(nearest, "label").join(F.broadcast(between), ["of", "cell"]).groupBy("of", "label", "vec_id").agg(F.min(F.col("far") + F.col("dist")).alias("bound"))
    order = W.partitionBy("of", "label").orderBy("bound")
    reached = bound.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k + 1)
    found = asked.join(reached, ["of", "label"], "left").groupBy("of").agg(F.max(F.coalesce("bound", F.lit(float("inf")))).alias("limit")).collect()  # a row a pivot
    out = np.full(n, -np.inf)
    for r in found:
        out[r["of"]] = r["limit"]
    return out


class _Groups:
    """Which groups the anchors of a cell form: near cells share one, a large cell has several."""

    def __init__(self, counts: np.ndarray) -> None:
        self.first, self.parts = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // GROUP))
        group, held = 0, 0
        for i, n in enumerate(counts):
            if held and held + n > GROUP:
                group, held = group + 1, 0
            self.first[i] = group
            held += n
            if self.parts[i] > 1:
                group, held = group + int(self.parts[i]), 0
        self.n = int((self.first + self.parts).max()) if len(counts) else 1

    def of_anchor(self) -> Column:
        cell, lot = F.col("cell") + 1, F.xxhash64("row")
        at = lambda x: F.element_at(F.array(*(F.lit(int(v)) for v in x)), cell)
        return (at(self.first) + F.pmod(lot, at(self.parts))).cast("int")


def _joined(placed: DataFrame, anchors: DataFrame, space: _Space, n_rows: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray, radius: np.ndarray, join: _Join) -> DataFrame:
    """Rows copied to the groups of anchors that they may serve, and joined there. ``low``, ``high``: the distances that matter to the anchors of each cell."""
    groups = _Groups(counts)
    cells = np.flatnonzero(counts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            apart, dist = space.apart[b.column("cell").to_numpy()][:, cells], b.column("dist").to_numpy()[:, None]
            near = np.maximum(apart - radius[cells] - dist, dist - apart - radius[cells])
            serves = (near <= high[cells] + space.slack) & (apart + radius[cells] + dist >= low[cells] - space.slack)
            goes = np.zeros((b.num_rows, groups.n), bool)
            for i, cell in enumerate(cells):
                goes[:, groups.first[cell] : groups.first[cell] + groups.parts[cell]] |= serves[:, i : i + 1]
            row, group = np.nonzero(goes)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            to = pa.ListArray.from_arrays(ends, pa.array(group.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.select(["vec_id", "label", "weights"]).columns, to], names=["vec_id", "label", "weights", "groups"])

    salts = max(1, -(-n_rows // max(TASK_ROWS, ROWS_AN_ANCHOR * min(GROUP, int(counts.max(initial=0))))))
    none = F.lit(None).cast("long")
    rows = placed.mapInArrow(route, f"{_ROW}, groups array<int>").select(F.explode("groups").alias("group"), F.pmod(F.xxhash64("vec_id", "weights", F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"), none.alias("row"), "vec_id", "label", "weights", F.lit(None).cast("array<long>").alias("bounds"))
    asked = anchors.select(groups.of_anchor().alias("group"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "row", "vec_id", "label", "weights", "bounds")
    met = rows.unionByName(asked).repartition(groups.n * salts, "group", "salt").sortWithinPartitions("group", "salt", F.col("row").asc_nulls_last())
    return met.mapInArrow(join, "row long, part int, vec_id long, score long")


def _products(a: np.ndarray, b: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where these hold them, else in longs, else in Python's numbers (of the pairs asked for)."""
    width = max(a.shape[1], b.shape[1])
    a, b = topk._widened(a, width), topk._widened(b, width)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    if most < 2**62:
        return a @ b.T
    scores = np.where(asked, a.astype(object) @ b.astype(object).T, 0)
    if ((scores < -(2**63)) | (scores >= 2**63)).any():
        raise OverflowError("a score exceeds a long")
    return scores.astype(np.int64)


class _Join:
    """Reads the anchors of a group, then keeps the best k of the rows that stream past, for each anchor and each of its ``bounds`` (pairs low, high of scores).

    Without bounds (``parts`` = 0) rows of the anchor's own label count, but for its id; with them rows of other labels.
    """

    def __init__(self, k: int, parts: int = 0) -> None:
        self.k, self.parts = k, parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, anchors = None, [], None
        for whole in textops.long_rows(batches):
            group, salt, asks = whole.column("group").to_numpy(), whole.column("salt").to_numpy(), whole.column("row").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (salt[1:] != salt[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(group)], strict=True):
                b = whole.slice(lo, hi - lo)
                if (group[lo], salt[lo]) != at:
                    yield from self._found(anchors)
                    at, held, anchors = (group[lo], salt[lo]), [], None
                if asks[lo]:
                    held.append(b)
                    continue
                if held:
                    anchors, held = _Anchors(held, self.k, max(1, self.parts), bool(self.parts)), []
                if anchors is not None:
                    step = max(64, BLOCK_SCORES // len(anchors.row))
                    for some in range(0, b.num_rows, step):
                        anchors.meet(b.slice(some, step))
        yield from self._found(anchors)

    @staticmethod
    def _found(anchors: _Anchors | None) -> Iterator[pa.RecordBatch]:
        if anchors is None:
            return
        who, part, place = np.nonzero(anchors.ids != topk.NO_ID)
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(anchors.row[who]), pa.array(part.astype(np.int32)), pa.array(anchors.ids[who, part, place]), pa.array(anchors.scores[who, part, place])], names=["row", "part", "vec_id", "score"])


class _Anchors:
    def __init__(self, batches: list[pa.RecordBatch], k: int, parts: int, bounded: bool) -> None:
        t = pa.Table.from_batches(batches).combine_chunks()
        self.row, self.id, self.label = (t.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.weights, self.k, self.bounded = topk._matrix(t.column("weights").combine_chunks(), 0), k, bounded
        n = len(self.row)
        self.scores, self.ids = np.full((n, parts, k), topk.NO_SCORE), np.full((n, parts, k), topk.NO_ID)
        self.low, self.high = np.full((n, parts), 1), np.zeros((n, parts), np.int64)  # a part that isn't there allows none
        if bounded:
            for i, bounds in enumerate(t.column("bounds").to_pylist()):
                self.low[i, : len(bounds) // 2], self.high[i, : len(bounds) // 2] = bounds[::2], bounds[1::2]

    def meet(self, b: pa.RecordBatch) -> None:
        ids, label = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
        same = self.label[:, None] == label[None, :]
        allowed = ~same if self.bounded else same & (self.id[:, None] != ids[None, :])
        scores = _products(self.weights, topk._matrix(b.column("weights"), 0), allowed)
        for part in range(self.scores.shape[1]):
            fits = allowed
            if self.bounded:
                fits = allowed & (scores >= self.low[:, part : part + 1]) & (scores <= self.high[:, part : part + 1])
            fits = fits & ((scores >= self.scores[:, part, -1:]) | (self.ids[:, part, -1:] == topk.NO_ID))  # only these can change
            who = np.flatnonzero(fits.any(axis=1))
            if len(who):
                s, i = np.where(fits[who], scores[who], topk.NO_SCORE), np.where(fits[who], ids[None, :], topk.NO_ID)
                self.scores[who, part], self.ids[who, part] = topk._best(np.concatenate([self.scores[who, part], s], axis=1), np.concatenate([self.ids[who, part], i], axis=1), self.k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """vec_id, label, weights of both -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best rows of the same label. The negatives of a positive are the best rows of other labels whose score lies
    between ``low`` and ``high`` per cent of the positive's.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    space, n = _space(rows)
    if space is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed = scratch.save(_placed(rows, space, False), "rows")
    asked = anchors.groupBy("vec_id", "label", "weights").count().drop("count")
    asked = scratch.save(_placed(asked, space, True).withColumn("row", F.monotonically_increasing_id()), "anchors")
    counts, radius = _cells(asked, space, [F.count("*"), F.max("dist")])
    limits = _limits(asked, placed, space, radius, positives)
    order = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    best = _joined(placed, asked.withColumn("bounds", F.lit(None).cast("array<long>")), space, n, np.zeros(len(counts)), limits, counts.astype(int), radius, _Join(positives))
    best = best.withColumn("at", F.row_number().over(order("row")) - 1).where(F.col("at") < positives)
    best = scratch.save(best.select("row", "at", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # floor(high p / 100) and ceil(low p / 100) without leaving a long
    rest, whole = F.expr("pmod(positive_score, 100L)"), F.expr("(positive_score - pmod(positive_score, 100L)) div 100L")
    bounds = best.select("row", "at", (low * whole + F.ceil(low * rest / 100)).cast("long").alias("lo"), (high * whole + F.floor(high * rest / 100)).cast("long").alias("hi"))
    in_order = F.sort_array(F.collect_list(F.struct("at", "lo", "hi")))  # as many as an anchor has positives
    per = bounds.groupBy("row").agg(in_order.alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("row", F.flatten(F.transform("b", lambda x: F.array(x["lo"], x["hi"]))).alias("bounds"), "lo", "hi")
    square = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) + F.lit(space.squares)
    far = lambda s: F.sqrt(F.greatest(square - 2.0 * F.col(s).cast("double"), F.lit(0.0)))
    still = scratch.save(asked.join(per.where("hi >= 0"), "row").withColumns({"near": far("hi"), "away": far("lo")}), "bounded")
    counts, radius, near, away = _cells(still, space, [F.count("*"), F.max("dist"), F.min("near"), F.max("away")])
    found = _joined(placed, still, space, n, near, away, counts.astype(int), radius, _Join(negatives, positives))
    found = found.withColumn("rank", F.row_number().over(order("row", "part"))).where(F.col("rank") <= negatives)
    named = best.join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row").withColumnRenamed("at", "part")
    return found.join(named, ["row", "part"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _cells(anchors: DataFrame, space: _Space, what: list[Column]) -> list[np.ndarray]:
    """Aggregates of the anchors by cell; 0 where there are none."""
    out = [np.zeros(len(space.pivots)) for _ in what]
    for r in anchors.groupBy("cell").agg(*(w.alias(f"_{i}") for i, w in enumerate(what))).collect():  # a row a pivot
        for i, x in enumerate(out):
            x[r["cell"]] = r[f"_{i}"]
    return out
