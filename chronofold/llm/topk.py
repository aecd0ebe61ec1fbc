"""Exact top-k by inner product with block-max pruning.

Vectors are sets of weighted terms (term = dimension, weight = the quantised component). Documents are range-partitioned by
their strongest term and id and cut into shards of a bounded size; a shard is ordered so that near vectors stand together
(halved along its widest direction, again and again) and cut into blocks. A block keeps the largest and smallest weight of
every term and a forward index, the matrix of its weights. For a query, a block's bound is the sum over terms of the larger
of weight times largest and weight times smallest. Each query takes the blocks in the order of its own bounds, some at a time,
and stops where the next bound lies below its k-th score. Scores equal to the k-th are not pruned, since the smaller id wins.

Whole shards are pruned the same way: their largest and smallest weights meet the queries in a join of bounded cells, a query
first searches the shard with its best bound, and then goes on only to shards whose bound reaches the k-th score found
there. A shard is held by one task, queries stream past it in groups of a bounded size, and the lists of shards are merged
by query. So memory depends neither on a table's size nor on the vectors' (the more components, the fewer vectors in a shard), and every vector is tested or bounded. Bounds of dense vectors in all
directions are loose; what is pruned depends on the data, and the results don't.

Defined cases: vectors that are null or hold a null or a non-finite component take no part; a component
or score beyond a long is an error; a shorter vector ends in zeros, one of any length is used whole; a query isn't its own
candidate, by id, also where rows repeat (a repeated candidate is a candidate of its own); equal rows of one query id are one
query, different vectors under one query id are queries of their own, each with its ranks; rows with a null
vec_id take no part; fewer than k candidates give fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm import textops
from chronofold.scratch import Scratch

SCALE = 256
#: Vectors of a block; vectors of a shard and queries of a group at most, and their bytes as doubles (a block of vectors, and a query, at least).
BLOCK = 128
SHARD, SHARD_BYTES = 32_768, 16 << 20
GROUP, GROUP_BYTES = 512, 2 << 20
#: Shards whose bounds a task holds at a time, about, and their bytes; and queries that meet them there.
CELL_SHARDS, CELL_BYTES = 4096, 32 << 20
CELL_QUERIES = 65_536
NO_SCORE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding -> vec_id, weights array<long>: floor(256 x); without the rows that take no part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    whole = lambda c: F.when(c.isNull() | (F.abs(c) < 2.0**63), F.floor(c)).otherwise(F.raise_error("a component exceeds a long").cast("long"))
    level = F.transform(x, lambda c: whole(c.cast("double") * SCALE))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select("vec_id", level.alias("weights"))


def _strongest(weights: Column) -> Column:
    """The term of the largest absolute weight, with its sign: blocks of one term have tight bounds for it."""
    sizes = F.transform(weights, lambda c: F.abs(c))
    at = F.array_position(sizes, F.array_max(sizes)).cast("int")
    return F.coalesce(at * F.signum(F.get(weights, at - 1)), F.lit(0.0)).cast("int")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array<long> column as a matrix, shorter rows filled with zeros. Whole numbers that came of doubles are exact as such."""
    column = column.cast(pa.large_list(pa.int64()))
    off = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(off)
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))))
    if len(values):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(off[0], off[-1]) - np.repeat(off[:-1], sizes)] = values[off[0] : off[-1]]
    return out


def _near_together(weights: np.ndarray, limit: int = BLOCK) -> np.ndarray:
    """An order of the rows in which near vectors stand together."""
    out, todo = [], [np.arange(len(weights))]
    while todo:
        some = todo.pop()
        if len(some) <= limit:
            out.append(some)
            continue
        rows = weights[some] - weights[some].mean(axis=0)
        along = np.random.default_rng(0).normal(size=rows.shape[1])
        for _ in range(6):  # towards the direction of the greatest spread
            along = rows.T @ (rows @ along)
            along /= np.linalg.norm(along) or 1.0
        order = some[np.argsort(rows @ along, kind="stable")]
        half = -(-len(order) // (2 * limit)) * limit  # whole blocks
        todo += [order[half:], order[:half]] if half < len(order) else [order[limit:], order[:limit]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _upper_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and range of weights the largest score possible, a little raised against rounding."""
    most = np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T + most * (1e-15 * (queries.shape[1] + 8))


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


class _Shard:
    """Blocks of candidates with their bounds. ``scored`` counts the pairs of a query and a block whose scores were computed."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray) -> None:
        order = _near_together(weights)
        self.ids, self.weights = ids[order], weights[order]
        cuts = np.arange(0, len(ids), BLOCK)
        self.cuts = np.append(cuts, len(ids))
        self.high, self.low = np.maximum.reduceat(self.weights, cuts, axis=0), np.minimum.reduceat(self.weights, cuts, axis=0)
        self.by_id = np.argsort(self.ids, kind="stable")
        self.most = float(np.abs(weights).max(initial=0))
        self.scored = 0

    def _own(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of a query, place of a vector with its id), in the order of places."""
        named = self.ids[self.by_id]
        lo, hi = np.searchsorted(named, query_ids, "left"), np.searchsorted(named, query_ids, "right")
        row = np.repeat(np.arange(len(query_ids)), hi - lo)
        place = self.by_id[np.repeat(lo, hi - lo) + np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        order = np.argsort(place, kind="stable")
        return row[order], place[order]

    def _scores(self, queries: np.ndarray, block: int, own: np.ndarray) -> np.ndarray:
        """Exact inner products with a block (``own`` pairs aside): in doubles where these hold them, else in longs, else in Python's numbers."""
        weights = _widened(self.weights[self.cuts[block] : self.cuts[block + 1]], queries.shape[1])
        most = float(np.abs(queries).max(initial=0)) * self.most * queries.shape[1]
        if most < 2**53:
            return queries @ weights.T
        queries, weights = queries.astype(np.int64), weights.astype(np.int64)
        if most < 2**62:
            return queries @ weights.T
        scores = np.where(own, 0, queries.astype(object) @ weights.astype(object).T)
        if ((scores < -(2**63)) | (scores >= 2**63)).any():
            raise OverflowError("a score exceeds a long")
        return scores.astype(np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, vec_id, score) of the top k of each query, at most k a query; of those below ``least`` some may be missing."""
        width = max(queries.shape[1], self.weights.shape[1])
        queries = _widened(queries, width)
        bounds = _upper_bounds(queries, _widened(self.high, width), _widened(self.low, width))
        order = np.argsort(-bounds, axis=1, kind="stable")
        n, blocks = bounds.shape
        top, top_ids = np.full((n, k), NO_SCORE), np.full((n, k), NO_ID)
        need = np.full(n, -np.inf) if least is None else least.astype(float)
        own_row, own_place = self._own(query_ids)
        done, take = 0, 1
        while done < blocks:
            upto = min(blocks, done + take)
            live = np.flatnonzero(bounds[np.arange(n), order[:, done]] >= need)
            if not len(live):
                break
            row, block = np.repeat(live, upto - done), order[live, done:upto].ravel()
            by_block = np.argsort(block, kind="stable")
            row, block = row[by_block], block[by_block]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                b = block[lo]
                rows = row[lo:hi]
                rows = rows[bounds[rows, b] >= need[rows]]
                if not len(rows):
                    continue
                self.scored += len(rows)
                first, last = self.cuts[b], self.cuts[b + 1]
                own = np.zeros((len(rows), last - first), bool)
                mine = slice(*np.searchsorted(own_place, (first, last)))
                at = np.minimum(np.searchsorted(rows, own_row[mine]), len(rows) - 1)  # rows rise
                here = rows[at] == own_row[mine]
                own[at[here], own_place[mine][here] - first] = True
                scores = self._scores(queries[rows], b, own)
                reach = scores.max(axis=1) >= need[rows]  # only these can change
                rows, scores, own = rows[reach], np.where(own[reach], NO_SCORE, scores[reach].astype(np.int64)), own[reach]
                if not len(rows):
                    continue
                ids = np.where(own, NO_ID, self.ids[first:last][None, :])
                top[rows], top_ids[rows] = _best(np.concatenate([top[rows], scores], axis=1), np.concatenate([top_ids[rows], ids], axis=1), k)
                full = top_ids[rows, -1] != NO_ID
                need[rows[full]] = np.maximum(need[rows[full]], top[rows[full], -1])
            done, take = upto, 4 * take
        row, col = np.nonzero(top_ids != NO_ID)
        return row, top_ids[row, col], top[row, col]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to smaller ids."""
    if scores.shape[1] > 4 * k:  # only what reaches the k-th highest value needs ordering
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        most = int((scores >= kth[:, None]).sum(axis=1).max())
        if most <= scores.shape[1] // 2:
            keep = np.argsort(-(scores >= kth[:, None]).astype(np.int8), axis=1, kind="stable")[:, :most]
            scores, ids = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


_QUERY = "query_key long, query_id long, query array<long>, least long"


def _placed(candidates: DataFrame, shards: int, shard: int) -> DataFrame:
    """shard, vec_id, weights: ranges of documents cut into shards of at most so many."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seen = TaskContext.get().partitionId() << 20, 0
        for b in textops.long_rows(batches):
            at = base + (seen + np.arange(b.num_rows)) // shard
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("vec_id"), b.column("weights")], names=["shard", "vec_id", "weights"])

    ranged = candidates.withColumn("strongest", _strongest(F.col("weights"))).repartitionByRange(shards, "strongest", "vec_id").sortWithinPartitions("strongest", "vec_id")
    return ranged.select("vec_id", "weights").mapInArrow(numbered, "shard long, vec_id long, weights array<long>")


def _extents(placed: DataFrame) -> DataFrame:
    """shard, high, low: the largest and smallest weight of every term, 0 counted in (a vector may be shorter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            shard, m = b.column("shard").to_numpy(), _matrix(b.column("weights"), 0)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1))
            high, low = (f.reduceat(m, cuts, axis=0).astype(np.int64) for f in (np.maximum, np.minimum))
            terms = np.tile(np.arange(m.shape[1], dtype=np.int32), len(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shard[cuts], m.shape[1])), pa.array(terms), pa.array(high.ravel()), pa.array(low.ravel())], names=["shard", "term", "high", "low"])

    by_term = placed.mapInArrow(run, "shard long, term int, high long, low long").groupBy("shard", "term").agg(F.greatest(F.max("high"), F.lit(0)).alias("high"), F.least(F.min("low"), F.lit(0)).alias("low"))
    terms = F.sort_array(F.collect_list(F.struct("term", "high", "low")))  # as many as a vector has components
    return by_term.groupBy("shard").agg(terms.alias("t")).select("shard", F.col("t.high").alias("high"), F.col("t.low").alias("low"))


def _routed(asked: DataFrame, extents: DataFrame, shards: int, queries: int, first: bool, width: int = 1) -> DataFrame:
    """The queries with the shards that they go to: of each cell of shards the one with the best bound, or all others whose bound reaches ``least``."""
    chunks, salts = -(-shards // max(1, min(CELL_SHARDS, CELL_BYTES // (16 * width)))), -(-queries // CELL_QUERIES)
    cell = lambda chunk, salt: (chunk * salts + salt).cast("long").alias("cell")
    of_shards = extents.select(F.pmod(F.xxhash64("shard"), F.lit(chunks)).alias("chunk"), "*").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    of_shards = of_shards.select(cell(F.col("chunk"), F.col("salt")), "shard", "high", "low", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _QUERY.split(", "))))
    of_queries = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    salt = F.pmod(F.xxhash64("query_id"), F.lit(salts))
    of_queries = of_queries.select(cell(F.col("chunk"), salt), F.lit(None).cast("long").alias("shard"), *(F.lit(None).cast("array<long>").alias(c) for c in ("high", "low")), "query_key", "query_id", "query", "least")
    met = of_shards.unionByName(of_queries).repartition(chunks * salts, "cell").sortWithinPartitions("cell", F.col("shard").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, extent = None, [], None
        for whole in textops.long_rows(batches):
            cells, is_shard = whole.column("cell").to_numpy(), whole.column("shard").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (is_shard[1:] != is_shard[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                b = whole.slice(lo, hi - lo)
                if cells[lo] != at:
                    at, held, extent = cells[lo], [], None
                if is_shard[lo]:
                    held.append((b.column("shard").to_numpy(), _matrix(b.column("high"), 0), _matrix(b.column("low"), 0)))
                    continue
                if held:
                    width = max(m.shape[1] for _, m, _ in held)
                    extent = np.concatenate([s for s, _, _ in held]), *(np.concatenate([_widened(x[i], width) for x in held]) for i in (1, 2))
                    held = []
                if extent is None:
                    continue
                for step in range(0, b.num_rows, 1024):
                    yield from _reached(b.slice(step, 1024), *extent)

    def _reached(b: pa.RecordBatch, names: np.ndarray, high: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        queries = _matrix(b.column("query"), high.shape[1])
        bounds = _upper_bounds(queries, _widened(high, queries.shape[1]), _widened(low, queries.shape[1]))
        best = np.argmax(bounds, axis=1)
        goes = np.zeros(bounds.shape, bool)
        if first:
            goes[np.arange(len(best)), best] = True
        else:
            goes = bounds >= b.column("least").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)[:, None]
            goes[np.arange(len(best)), best] = False
        row, col = np.nonzero(goes)
        if len(row):
            out = b.select(["query_key", "query_id", "query", "least"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(names[col]), *out.columns], names=["shard", "query_key", "query_id", "query", "least"])

    return met.mapInArrow(run, f"shard long, {_QUERY}")


def _searched(placed: DataFrame, asked: DataFrame, shards: int, k: int, group: int) -> DataFrame:
    """query_key, query_id, vec_id, score: the lists of the shards that the queries go to."""
    candidates = placed.select("shard", "vec_id", "weights", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _QUERY.split(", ") if "array" not in x)))
    queries = asked.select("shard", F.lit(None).cast("long").alias("vec_id"), F.col("query").alias("weights"), "query_key", "query_id", "least")
    met = candidates.unionByName(queries).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    return met.mapInArrow(_Search(k, group), "query_key long, query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """vec_id, weights of both -> query_id, rank, vec_id, score."""
    scratch = Scratch(candidates.sparkSession)
    asked = queries.groupBy("vec_id", "weights").count().select(F.xxhash64("weights").alias("query_key"), F.col("vec_id").alias("query_id"), F.col("weights").alias("query"), F.lit(None).cast("long").alias("least"))
    asked = scratch.save(asked, "queries")
    seen = candidates.agg(F.count("*").alias("n"), F.max(F.size("weights")).alias("width")).first()
    width = max(1, seen["width"] or 1)
    shard, group = min(shard, max(BLOCK, SHARD_BYTES // (8 * width))), min(group, max(1, GROUP_BYTES // (8 * width)))
    placed = scratch.save(_placed(candidates, max(1, -(-seen["n"] // shard)), shard), "shards")
    extents = scratch.save(_extents(placed), "extents")
    shards, n_queries = max(1, extents.count()), max(1, asked.count())
    best = scratch.save(_searched(placed, _routed(asked, extents, shards, n_queries, True, width), shards, k, group), "first")
    order = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    if shards > 1:
        kth = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "query_key", F.col("score").alias("least"))
        still = asked.drop("least").join(kth, ["query_id", "query_key"], "left").select("query_key", "query_id", "query", "least")
        best = best.unionByName(_searched(placed, _routed(still, extents, shards, n_queries, False, width), shards, k, group))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Search:
    """Reads a shard's candidates, then answers its queries, a group at a time."""

    def __init__(self, k: int, group: int) -> None:
        self.k, self.group = k, group

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for whole in textops.long_rows(batches):
            shard, asks = whole.column("shard").to_numpy(), whole.column("query_id").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                b = whole.slice(lo, hi - lo)
                if shard[lo] != at:
                    at, held, index = shard[lo], [], None
                if not asks[lo]:
                    held.append((b.column("vec_id").to_numpy(), _matrix(b.column("weights"), 0)))
                    continue
                if held:
                    width = max(m.shape[1] for _, m in held)
                    index = _Shard(np.concatenate([i for i, _ in held]), np.concatenate([_widened(m, width) for _, m in held]))
                    held = []
                for step in range(0, b.num_rows, self.group):
                    some = b.slice(step, self.group)
                    ids, keys = some.column("query_id").to_numpy(), some.column("query_key").to_numpy()
                    least = some.column("least").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    row, found, score = index.search(ids, _matrix(some.column("weights"), 0), self.k, least)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array(ids[row]), pa.array(found), pa.array(score)], names=["query_key", "query_id", "vec_id", "score"])
