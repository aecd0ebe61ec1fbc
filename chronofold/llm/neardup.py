"""Near-duplicate classes by a MinHash LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of word 5-grams (hashed), a 128-bit print of the set and 128 min-hashes. Documents with equal
   sets are one class from here on.
2. Forest: each tree orders the classes by its own permutation of the signature. Neighbours are classes whose longest
   common prefix reaches ``MIN_DEPTH``; a run of them is a region. A region of more than ``REGION`` classes is parted where
   its members' prefixes differ, one level deeper at a time, so depth follows the density around it.
3. In a region, signatures estimate similarities. Small regions propose every pair that may reach the limit. Large ones
   first propose a linear number: neighbours in order, and all against the member nearest to the region's usual
   signature. Pairs are confirmed on the full sets, and links joined to components.
4. In a large region where several components meet, the full sets of its members are compared by products of 0/1
   matrices, those outside its largest component with all, and a link to each other component is added. So no link that
   would join two components is lost there, and the pairs of a region are never listed.
5. Runs that were divided into several regions, by their size or by a bound of the range partitions, are made whole again: first one member a component and run is compared as
   in a region, so that what belongs together joins by few links. Then the members outside a run's largest component meet
   all members of divided runs in an exact join of sets: two sets that reach the limit share a shingle among the rarest 15
   of 100 of both. So no link that would join two components of a run is lost, whatever its size.

A region whose full sets together exceed ``REGION_BYTES`` (long texts) is treated as a divided run, so that no task holds it.

Components are found by alternating large-star and small-star steps, as joins and minima over the edge list, until a count, a
sum and a xor of 64-bit hashes of the edges stay the same; nothing about documents comes to the driver but those.

Defined cases: a null or empty text, or one without words, has an empty set, links with nothing and is kept; a text of any length
has all its shingles, in memory in proportion to it; repeated rows share a class; ties of ids fall to the smallest; different
texts under one doc_id are judged each by itself (rows of one doc_id may then differ in component_id); a row with a null
doc_id is judged by its text but represents nothing (if only such rows have a text it stands alone, with a null component);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm import textops
from chronofold.scratch import Scratch
from chronofold.llm.textops import U64

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
HASHES = 128
TREES = 24
MIN_DEPTH = 5
DEPTH = 8
#: Classes of a region, at most, before it is parted by a deeper prefix.
REGION = 2048
#: Bytes of the full sets of a region, at most, that a task compares at once.
REGION_BYTES = 64 << 20
#: Regions up to this size propose all their likely pairs at once.
SMALL = 12
#: Estimates deviate by 0.03 at the limit with 128 hashes; pairs from this estimate on are confirmed.
LIKELY = 0.70
SEED = 11
#: Shingles are ordered by how often their leading bits occur; the order decides how many pairs meet, not which links are found.
BUCKET_BITS = 16


def _multipliers() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)


def _orders() -> np.ndarray:
    """The signature positions that each tree compares, in order. Leading positions differ between trees as long as they last."""
    rng = np.random.default_rng(SEED + 1)
    ring = np.concatenate([rng.permutation(HASHES) for _ in range(-(-TREES * MIN_DEPTH // HASHES))])
    out = np.zeros((TREES, DEPTH), np.int64)
    for t in range(TREES):
        head = ring[t * MIN_DEPTH : (t + 1) * MIN_DEPTH]
        rest = rng.permutation(np.setdiff1d(np.arange(HASHES), head))
        out[t] = np.concatenate([head, rest])[:DEPTH]
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a text with fewer words has its whole sequence, without words none."""
    data = textops.LOWER[data]
    start, end, first = textops.words(data, offsets, textops.NOT_SPACE)
    tokens = textops.span_hashes(data, start, end)
    at, counts = textops.gram_starts(first, SHINGLE)
    grams = textops.gram_hashes(tokens, SHINGLE)[at]
    bounds = np.concatenate(([0], np.cumsum(counts)))
    out = []
    for i in range(len(offsets) - 1):
        if counts[i]:
            out.append(np.unique(grams[bounds[i] : bounds[i + 1]]))
        else:
            few = tokens[first[i] : first[i + 1]]
            out.append(textops.gram_hashes(few, len(few)) + U64(len(few)) if len(few) else np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each of the HASHES minima of each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.zeros((len(sets), HASHES), np.uint16)
    with np.errstate(over="ignore"):
        for i, m in enumerate(_multipliers()):
            least = np.minimum.reduceat((flat * m) >> U64(20), starts)
            out[:, i] = (textops.mix(least) >> U64(48)).astype(np.uint16)
    return out


def document_prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print (16 bytes; null for an empty set), signature (2 * HASHES bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            data, offsets = textops.text_bytes(b.column("text"))
            n, prints, signs = [], [], []
            for lo, hi in textops.pieces(offsets, 1 << 18):
                sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n += [len(s) for s in sets]
                prints += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                signs += [next(rows).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "print", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, signature binary")


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(column), width)


def forest(classes: DataFrame) -> DataFrame:
    """A row a class and tree: tree, key (the ordered signature values, big-endian so that bytes sort like them), id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders()
        for b in textops.long_rows(batches):
            sign = _fixed(b.column("signature"), "u2", HASHES)
            keys = sign[:, orders].astype(">u2").tobytes()
            n = len(sign) * TREES
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (2 * DEPTH)), pa.py_buffer(keys)])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(sign))), binary, pa.array(np.repeat(b.column("id").to_numpy(), TREES))], names=["tree", "key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "tree int, key binary, id long")


def _part(keys: np.ndarray, lo: int, hi: int, depth: int, limit: int = REGION) -> Iterator[tuple[int, int]]:
    """Regions of the sorted run lo..hi, which shares ``depth`` values: parted deeper where it is too large; equal keys by number. They cover it, so some may have one member."""
    if hi - lo <= limit:
        yield lo, hi
    elif depth == DEPTH:
        for at in range(lo, hi, limit):
            yield at, min(hi, at + limit)
    else:
        cuts = lo + 1 + np.flatnonzero(keys[lo + 1 : hi, depth] != keys[lo : hi - 1, depth])
        for a, b in zip([lo, *cuts], [*cuts, hi], strict=True):
            yield from _part(keys, a, b, depth + 1, limit)


def _run_hashes(tree: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number of each row's run (its tree and first values), the same in every task. Runs that share one are compared as one."""
    out = tree.astype(U64)
    with np.errstate(over="ignore"):
        for j in range(MIN_DEPTH):
            out = textops.mix(out * U64(textops.RADIX) + keys[:, j].astype(U64) + U64(1))
    return out.view(np.int64)


def regions(rows: DataFrame, limit: int = REGION) -> DataFrame:
    """Members of the forest's regions: region, place (in order), size, id, run, divided (the region may be a part of its run). Trees are range-partitioned in their order, so even a dense stretch is spread over tasks; a task holds one run of equal prefixes at a time, in blocks."""
    ranged = rows.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number, began = TaskContext.get().partitionId() << 40, 0, True  # a range's first run may have begun in the one before, and its last one go on
        keep_tree, keep_key, keep_id = np.zeros(0, np.int32), np.zeros((0, DEPTH), ">u2"), np.zeros(0, np.int64)

        def cut(tree: np.ndarray, keys: np.ndarray, ids: np.ndarray, goes_on: bool = False) -> pa.RecordBatch | None:
            """Regions of these rows; the first run may be the rest of one before, the last one ``goes_on``."""
            nonlocal number, began
            new = np.flatnonzero((tree[1:] != tree[:-1]) | (keys[1:, :MIN_DEPTH] != keys[:-1, :MIN_DEPTH]).any(axis=1)) + 1
            bounds = np.concatenate(([0], new, [len(tree)]))
            is_part = np.zeros(len(bounds) - 1, bool)
            is_part[0] |= began
            is_part[-1] |= goes_on
            began = goes_on
            found, divided = [], []
            for i in np.flatnonzero((np.diff(bounds) > 1) | is_part):
                parts = list(_part(keys, int(bounds[i]), int(bounds[i + 1]), MIN_DEPTH, limit))
                found += parts
                divided += [is_part[i] or len(parts) > 1] * len(parts)
            if not found:
                return None
            sizes = [b - a for a, b in found]
            where = np.concatenate([np.arange(a, b) for a, b in found])
            columns = {
                "region": pa.array(np.repeat(base + number + np.arange(len(found)), sizes)),
                "place": pa.array(np.concatenate([np.arange(s) for s in sizes]), pa.int32()),
                "size": pa.array(np.repeat(sizes, sizes), pa.int32()),
                "id": pa.array(ids[where]),
                "run": pa.array(_run_hashes(tree[where], keys[where])),
                "divided": pa.array(np.repeat(np.array(divided, bool), sizes)),
            }
            number += len(found)
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for b in textops.long_rows(batches):
            tree = np.concatenate([keep_tree, b.column("tree").to_numpy()])
            keys = np.concatenate([keep_key, _fixed(b.column("key"), ">u2", DEPTH)])
            ids = np.concatenate([keep_id, b.column("id").to_numpy()])
            same = (tree == tree[-1]) & (keys[:, :MIN_DEPTH] == keys[-1, :MIN_DEPTH]).all(axis=1)
            whole = int(len(tree) - np.argmin(same[::-1])) if not same.all() else 0
            dense = whole == 0 and len(tree) > 64 * limit
            if dense:  # a dense stretch: all but its last deepest run
                deep = (keys == keys[-1]).all(axis=1)
                whole = int(len(tree) - np.argmin(deep[::-1])) if not deep.all() else len(tree)
            if whole and (out := cut(tree[:whole], keys[:whole], ids[:whole], dense)) is not None:
                yield out
            keep_tree, keep_key, keep_id = tree[whole:], keys[whole:], ids[whole:]
        if len(keep_tree) and (out := cut(keep_tree, keep_key, keep_id, True)) is not None:
            yield out

    return ranged.mapInArrow(run, "region long, place int, size int, id long, run long, divided boolean")


def _by_region(members: DataFrame) -> DataFrame:
    return members.repartition("region").sortWithinPartitions("region", "place")


def _whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut at region bounds."""
    kept: list[pa.RecordBatch] = []
    for b in textops.long_rows(batches):
        region = b.column("region").to_numpy()
        if kept and kept[-1].column("region")[-1].as_py() != region[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        at = int(np.searchsorted(region, region[-1]))
        if at:
            kept.append(b.slice(0, at))
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(b.slice(at))
    if kept:
        yield pa.Table.from_batches(kept)


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sign = _fixed(t.column("signature").combine_chunks(), "u2", HASHES)
    return t.column("region").to_numpy(), t.column("size").to_numpy(), t.column("id").to_numpy(), sign


def _usual(sign: np.ndarray) -> int:
    """The row nearest to the signature that takes each position's most frequent value."""
    ordered = np.sort(sign, axis=0)
    usual = np.zeros(HASHES, np.uint16)
    for j in range(HASHES):
        values, counts = np.unique(ordered[:, j], return_counts=True)
        usual[j] = values[np.argmax(counts)]
    return int(np.argmax((sign == usual).sum(axis=1)))


def _first_pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
    region, size, ids, sign = _columns(t)
    need = LIKELY * HASHES
    for step in range(1, SMALL):
        a = np.flatnonzero((region[:-step] == region[step:]) & ((size[:-step] <= SMALL) | (step == 1))) if len(region) > step else np.zeros(0, np.int64)
        for at in range(0, len(a), 1 << 14):
            some = a[at : at + (1 << 14)]
            likely = some[(sign[some] == sign[some + step]).sum(axis=1) >= need]
            if len(likely):
                yield _pairs_batch(ids[likely], ids[likely + step])
    bounds = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
    for lo in bounds[size[bounds] > SMALL]:
        hi = lo + size[lo]
        hub = lo + _usual(sign[lo:hi])
        likely = lo + np.flatnonzero((sign[lo:hi] == sign[hub]).sum(axis=1) >= need)
        likely = likely[likely != hub]
        if len(likely):
            yield _pairs_batch(np.full(len(likely), ids[hub]), ids[likely])


def _exact_links(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of full sets between the components that meet in a region: for each member outside the largest, one to each component that it links with."""
    region, component, ids = (t.column(c).to_numpy() for c in ("region", "component", "id"))
    raw = t.column("members")
    cuts = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True])))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw.slice(lo, hi - lo)]
        own, part = ids[lo:hi], component[lo:hi]
        values, counts = np.unique(part, return_counts=True)
        rest = np.flatnonzero(part != values[np.argmax(counts)])
        if not len(rest):
            continue
        size = np.array([len(x) for x in sets])
        shared = _shared(sets, rest)
        linked = (100 * shared >= PERCENT * (size[rest][:, None] + size[None, :] - shared)) & (part[rest][:, None] != part[None, :])
        for i in np.flatnonzero(linked.any(axis=1)):
            other = np.flatnonzero(linked[i])
            _, first = np.unique(part[other], return_index=True)
            yield _pairs_batch(np.full(len(first), own[rest[i]]), own[other[first]])


def _shared(sets: list[np.ndarray], rows: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of some of the sets with all of them, by products of 0/1 matrices, a range of members at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.concatenate(([0], np.cumsum(flat[1:] != flat[:-1])))
    common = (np.bincount(column) > 1)[column]
    owner, column = owner[common], column[common]
    out = np.zeros((len(rows), len(sets)), np.int64)
    if not len(column):
        return out
    column = np.concatenate(([0], np.cumsum(column[1:] != column[:-1])))
    for lo in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        out += np.rint(block[rows] @ block.T).astype(np.int64)
    return out


def _proposed(members: DataFrame, propose) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_regions(batches):
            yield from propose(t)

    return _by_region(members).mapInArrow(run, "a long, b long").distinct()


def class_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, members (the sorted shingle hashes) of the documents in ``ids``."""
    wanted = docs.select(F.col("doc_id").alias("id"), "text").hint("merge").join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in textops.long_rows(batches):
            id_ = b.column("id").to_numpy()
            new = np.concatenate(([id_[0] != before], id_[1:] != id_[:-1]))  # the join's rows come sorted by id
            before = id_[-1]
            b = b.filter(pa.array(new))
            data, offsets = textops.text_bytes(b.column("text"))
            sets = [s.tobytes() for lo, hi in textops.pieces(offsets) for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], names=["id", "members"])

    return wanted.mapInArrow(run, "id long, members binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("members").alias(f"of_{c}")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("of_a"), b.column("of_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _save_links(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The confirmed pairs, dealt anew: full sets are compared in all tasks, the few links written by few."""
    return scratch.save(confirm(pairs, sets).repartition(scratch.few()), "links")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id -> component (the smallest id reachable) for every id in an edge (a < b)."""
    now, before = scratch.save(edges.distinct(), "edges", light=True), None
    while True:
        near = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        then = scratch.save(small, "edges", light=True)
        scratch.drop(now)
        own = F.xxhash64("a", "b")
        mark = then.agg(F.count("*"), F.sum(own.cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == before:
            return then.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(then.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()
        now, before = then, mark


def _with_component(rows: DataFrame, joined: DataFrame) -> DataFrame:
    return rows.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _likely_across(placed: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """Likely pairs among the first members of the components that meet in a run, in blocks of about ``limit``."""
    first = placed.groupBy("run", "component").agg(F.min("id").alias("id"))
    blocks = first.groupBy("run").agg(F.ceil(F.count("*") / limit).alias("blocks"))
    dealt = first.join(blocks, "run").select("id", F.xxhash64("run", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("region")).distinct()
    own = W.partitionBy("region")
    members = dealt.select("region", F.row_number().over(own.orderBy("id")).alias("place"), F.count("*").over(own).cast("int").alias("size"), "id").where("size > 1")
    return _proposed(members.join(classes.select("id", "signature"), "id"), _first_pairs)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles of each bucket (their leading bits) occur in the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in textops.long_rows(batches):
            for x in b.column("members"):
                seen += np.bincount(_bucket(np.frombuffer(x.as_buffer(), np.uint64)), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    found = sets.select("members").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _sharing_rare(sets: DataFrame, limit: int) -> DataFrame:
    """id, component, rest, members -> pairs a < b of a member of the rest with one of another component that may reach the limit.

    In any order of shingles, the first one that two such sets share is among the first n - ceil(PERCENT n / 100) + 1 of both,
    and what follows it must suffice. Rare ones come first, so few pairs meet; a shingle of many is met in blocks.
    """
    often = _frequencies(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            heads, sizes = [], []
            for x in b.column("members"):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                heads.append(x[np.lexsort((x, often[_bucket(x)]))][: len(x) - -(-PERCENT * len(x) // 100) + 1])
                sizes.append(len(x))
            row = np.repeat(np.arange(b.num_rows), [len(h) for h in heads])
            left = np.concatenate([n - np.arange(len(h)) for n, h in zip(sizes, heads, strict=True)])
            columns = {"shingle": pa.array(np.concatenate(heads).view(np.int64)), "left": pa.array(left, pa.int64()), "n": pa.array(np.array(sizes)[row], pa.int64())}
            columns |= {c: b.column(c).take(pa.array(row)) for c in ("id", "component", "rest")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    heads = sets.select("id", "component", "rest", "members").mapInArrow(run, "shingle long, left long, n long, id long, component long, rest boolean")
    blocks = heads.groupBy("shingle").agg(F.count("*").alias("all"), F.max("rest").alias("asked"), (F.min("component") < F.max("component")).alias("apart")).where("all > 1 and asked and apart")
    heads = heads.join(blocks.select("shingle", F.ceil(F.col("all") / limit).cast("int").alias("blocks")).hint("merge"), "shingle")
    x = heads.where("rest").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    y = heads.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    shared = F.least("x.left", "y.left")
    fits = (F.col("x.component") != F.col("y.component")) & (100 * shared >= PERCENT * (F.col("x.n") + F.col("y.n") - shared))
    met = x.alias("x").hint("merge").join(y.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") == F.col("y.block")) & fits)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _join_divided(parts: DataFrame, classes: DataFrame, sets: DataFrame, links: DataFrame, joined: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """The components with the links inside runs (run, id) that are in parts, or too large for one task, that join two of them."""
    runs = scratch.save(parts, "divided", light=True)
    if not runs.limit(1).count():
        return joined
    for find in (_likely_across, _likely_across, None):
        placed = _with_component(runs, joined)
        apart = placed.groupBy("run").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("run")
        placed = scratch.save(placed.join(apart, "run", "left_semi"), "placed", light=True)
        if find:
            pairs = find(placed, classes, limit)
        else:
            largest = placed.groupBy("run", "component").count().groupBy("run").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
            judged = placed.join(largest, "run").groupBy("id", "component").agg(F.max(F.col("component") != F.col("largest")).alias("rest"))
            pairs = _sharing_rare(scratch.save(judged.join(sets.hint("merge"), "id"), "divided-sets"), limit)
        found = _save_links(scratch.save(pairs, "pairs", light=True), sets, scratch)
        if found.limit(1).count():
            links = links.unionByName(found)
            joined = components(links, scratch)
    return joined


def near_duplicates(docs: DataFrame, region: int = REGION, region_bytes: int = REGION_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (it is the document's own)."""
    judged, rows, _ = _all_judged(docs, region, region_bytes)
    if rows is None:
        return judged
    ids = rows.select("_row", "doc_id")
    first = ids.select(F.col("_row").alias("component_id"), F.col("doc_id").alias("least"))  # rows are numbered in the order of their ids, so a component's first row has its smallest
    named = judged.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id").join(ids.hint("merge"), "_row").join(first.hint("merge"), "component_id")
    return named.select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("least"), F.col("least").isNull()).alias("kept"))


def _all_judged(docs: DataFrame, region: int = REGION, region_bytes: int = REGION_BYTES) -> tuple[DataFrame, DataFrame | None, bool]:
    """The judgements and whether ids repeat. Where an id has different texts, the judgements name the rows of the second result, which have numbers (``_row``) of their own in the order of ids."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(document_prints(docs), "prints")
    text = F.coalesce("print", F.lit(bytearray()))  # an empty text is a text of its own
    ids = prints.where("doc_id is not null").groupBy("doc_id").agg((F.count("*") > 1).alias("again"), (F.min(text) < F.max(text)).alias("differ"))
    seen = ids.agg(F.max("again").alias("again"), F.max("differ").alias("differ")).first()
    if not seen["differ"]:
        return _judged(docs, prints, scratch, region, region_bytes), None, bool(seen["again"])
    scratch.drop(prints)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = scratch.save(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col("_row").alias("doc_id"), "text")
    return _judged(own, scratch.save(document_prints(own), "prints"), scratch, region, region_bytes), rows, True


def _judged(docs: DataFrame, prints: DataFrame, scratch: Scratch, region: int, region_bytes: int) -> DataFrame:
    known = prints.where("n_shingles > 0 and doc_id is not null").groupBy("print")
    classes = scratch.save(known.agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "classes", light=True)
    members = scratch.save(regions(forest(classes), region), "members")
    signed = members.where("size > 1").select("region", "place", "size", "id").join(classes.select("id", "signature"), "id")
    pairs = scratch.save(_proposed(signed, _first_pairs), "pairs", light=True)
    sets = scratch.save(class_sets(docs, members.where((F.col("size") > SMALL) | F.col("divided")).select("id").union(pairs.select("a")).union(pairs.select("b")).distinct()), "sets")
    links = _save_links(pairs, sets, scratch)
    scratch.drop(pairs)
    joined = components(links, scratch)
    large = _with_component(members.where(F.col("size") > SMALL).select("region", "place", "id"), joined).join(classes.select("id", "n_shingles"), "id")
    of_regions = large.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"), (8 * F.sum("n_shingles") > region_bytes).alias("heavy"))
    apart = scratch.save(of_regions.where("least < most").select("region", "heavy"), "apart", light=True)
    open_regions = large.join(apart.where("not heavy"), "region", "left_semi").join(sets.hint("merge"), "id").select("region", "place", "id", "component", "members")
    more = scratch.save(_proposed(open_regions, _exact_links), "more-links", light=True)
    if more.limit(1).count():
        links = links.unionByName(more)
        joined = components(links, scratch)
    parts = members.where("divided")
    several = parts.groupBy("run").agg(F.min("region").alias("least"), F.max("region").alias("most")).where("least < most").select("run")
    heavy = members.join(apart.where("heavy"), "region", "left_semi").select(F.xxhash64("region").alias("run"), "id")
    joined = _join_divided(parts.join(several, "run", "left_semi").select("run", "id").unionByName(heavy), classes, sets, links, joined, scratch, region)
    scratch.drop(sets)
    known = classes.select("print", "id").join(joined, "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    out = prints.select("doc_id", "n_shingles", "print").join(known, "print", "left")
    component = F.when(F.col("doc_id").isNotNull() | F.col("component").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of documents that represent their class, with all their columns.

    Of rows equal in id and text the one with the least hash of all columns stays; different texts under one id are judged each by itself; rows with
    a null doc_id can't be told apart, and all stay. Columns of a type without a hash (maps) are left out of it.
    """
    named = docs.where("doc_id is not null")
    judged, rows, again = _all_judged(named)
    kept = judged.where("kept").select("doc_id")
    own = named.join(kept, "doc_id", "left_semi") if rows is None else rows.join(kept.select(F.col("doc_id").alias("_row")), "_row", "left_semi")
    if again:
        hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
        own = own.groupBy("doc_id", F.xxhash64("text").alias("_text")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("_r")).select("_r.*")
    return own.select(docs.columns).unionByName(docs.where("doc_id is null"))
