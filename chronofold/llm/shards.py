"""Training-order materialisation of token sequences.

Documents are packed into sequences of one length. Each sequence gets a dense number (the tasks' counts summed up), and a
keyed Feistel permutation of 0..N-1 turns the number into its slot in the training order: a network over the smallest
even number of bits, walked on until it lands below N, so no table of the permutation exists anywhere. Slots are
shuffled to one task a range, which writes the range as one shard: records of a fixed number of bytes in slot order, so that
slot s stands in shard s // records at byte (s % records) * stride and a reader can resume anywhere.

A task that runs again writes the same file and renames it into place, so lost executors and speculative copies do no harm.
By default each task packs its own input split, nothing is shuffled before the slots, and a shard's bytes depend on the
key, the documents *and how the scan was split* (``layout`` tells: tasks and their sequences). With ``bucket_documents`` the
documents are first dealt to buckets by a hash of doc_id and text and ordered in them by both, and a shard's bytes depend on
the documents and the key alone, whatever the partitioning, for one more shuffle of the texts.

Without ``out_dir`` the shards lie in the scratch folder, which goes when the driver's Python ends.

Defined cases: as for packing; the last record of a task or bucket is padded with 0 after n_tokens ids; equal
rows share a bucket, which one task streams; an empty table gives no shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm import packing, textops, tokens
from chronofold.scratch import Scratch

SEQUENCE_TOKENS = 2048
SHARD_RECORDS = 4096
ROUNDS = 6
#: Ids below 2**16 are written in two bytes.
TOKEN_BYTES = 2


def feistel_slots(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of ``index`` under the keyed permutation of 0..n-1."""
    half = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = textops.mix(np.uint64(key & (2**64 - 1)) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(textops.RADIX % 2**63))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (textops.mix(right ^ k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def packed_sequences(docs: DataFrame, length: int = SEQUENCE_TOKENS, paths: tuple[str, str] | None = None, bucket_documents: int | None = None) -> DataFrame:
    """Sequences of one length: task (or bucket), local (its number there), n_tokens, doc_ids, body (little-endian 16-bit ids)."""
    paths = paths or tokens.default_paths()

    def each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The batches come sorted by bucket; each bucket is packed by itself."""
        waiting: list[pa.RecordBatch] = []
        stream = textops.long_rows(batches)

        def of(bucket: int) -> Iterator[pa.RecordBatch]:
            while True:
                b = waiting.pop() if waiting else next(stream, None)
                if b is None:
                    return
                n = int(np.searchsorted(b.column("bucket").to_numpy(), bucket, "right"))
                if n < b.num_rows:
                    waiting.append(b.slice(n))
                if n:
                    yield b.slice(0, n)
                if n < b.num_rows:
                    return

        while True:
            if not waiting:
                b = next(stream, None)
                if b is None:
                    return
                waiting.append(b)
            bucket = int(waiting[-1].column("bucket")[0].as_py())
            yield from packing.packed(of(bucket), (length,), length, packing.WINDOW, paths, bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for number, _, _, inside in each_bucket(batches) if bucket_documents else packing.packed(batches, (length,), length, packing.WINDOW, paths):
            ids = np.frombuffer(b"".join(p[4] for p in inside), "<u4")
            if len(ids) and ids.max() >= 1 << 8 * TOKEN_BYTES:
                raise ValueError("an id doesn't fit its bytes")
            body = np.zeros(length, "<u2")
            body[: len(ids)] = ids
            rows.append((number >> 36, number & ((1 << 36) - 1), len(ids), list(dict.fromkeys(p[2] for p in inside)), body.tobytes()))
            if len(rows) >= 1024:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["task", "local", "n_tokens", "doc_ids", "body"])

    rows = docs.select("doc_id", "text")
    if bucket_documents:
        buckets = -(-docs.count() // bucket_documents) or 1
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "text")
    return rows.mapInArrow(run, "task long, local long, n_tokens int, doc_ids array<long>, body binary")


def write_shards(docs: DataFrame, out_dir: str | None = None, key: int = 20240229, length: int = SEQUENCE_TOKENS, records: int = SHARD_RECORDS, paths: tuple[str, str] | None = None, bucket_documents: int | None = None) -> DataFrame:
    """Writes shard-NNNNNNNN.bin files to ``out_dir`` (a folder that all executors reach) when the result is computed.

    A row a sequence: slot, shard, byte_offset, sequence_id (its dense number), n_tokens, doc_ids, crc32 (of the record), layout (a digest of the tasks' or buckets' numbers of sequences, which together
    with the key and the documents determine the order).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    out_dir = out_dir or scratch.path("shards")
    saved = scratch.save(packed_sequences(docs, length, paths, bucket_documents), "sequences", level=6)
    counts = saved.groupBy("task").agg(F.count("*").alias("n"))
    first = counts.select("task", (F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    total, layout = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor(F.xxhash64("task", "n"))).first()
    n_shards = max(1, -(-total // records))
    # broadcast: 16 bytes a task of the packing, whatever the tasks hold
    numbered = saved.join(F.broadcast(first), "task").select((F.col("first") + F.col("local")).alias("sequence_id"), "n_tokens", "doc_ids", "body")
    routed = numbered.mapInArrow(_Router(total, key, records), "shard int, slots array<long>, sequence_ids array<long>, n_tokens array<int>, doc_ids array<array<long>>, bodies binary")
    return routed.repartitionById(n_shards, F.col("shard")).mapInArrow(_Writer(out_dir, length, records), "slot long, shard long, byte_offset long, sequence_id long, n_tokens int, doc_ids array<long>, crc32 long").withColumn("layout", F.lit(layout).cast("long"))


class _Router:
    """Gives sequences their slots, and sends those of one shard on together, compressed as one."""

    def __init__(self, total: int, key: int, records: int) -> None:
        self.total, self.key, self.records = total, key, records

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=6)
        for b in textops.long_rows(batches):
            slots = feistel_slots(b.column("sequence_id").to_numpy(), self.total, self.key)
            order = np.argsort(slots)
            b, slots = b.take(pa.array(order)), slots[order]
            cuts = np.flatnonzero(np.diff(slots // self.records)) + 1
            bounds = np.concatenate(([0], cuts, [len(slots)]))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x)
            body = b.column("body")
            blobs = [codec.compress(b"".join(x.as_buffer() for x in body.slice(lo, hi - lo)), asbytes=True) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots[bounds[:-1]] // self.records, pa.int32()), lists(pa.array(slots)), lists(b.column("sequence_id")), lists(b.column("n_tokens")), lists(b.column("doc_ids")), pa.array(blobs, pa.binary())],
                names=["shard", "slots", "sequence_ids", "n_tokens", "doc_ids", "bodies"],
            )


class _Writer:
    """Lays the records of a shard out by slot and writes them; a shard is a bounded number of records."""

    def __init__(self, out_dir: str, length: int, records: int) -> None:
        self.out_dir, self.length, self.records = out_dir, length, records

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import zlib

        from pyarrow import fs

        stride = self.length * TOKEN_BYTES
        codec, shard, space, rows = pa.Codec("zstd"), None, bytearray(), []
        for b in batches:
            for r in b.to_pylist():
                if shard is None:
                    shard = r["shard"]
                at = [s % self.records for s in r["slots"]]
                bodies = codec.decompress(r["bodies"], stride * len(at), asbytes=True)
                space.extend(bytes(max(0, (max(at) + 1) * stride - len(space))))
                for i, s in enumerate(at):
                    record = bodies[i * stride : (i + 1) * stride]
                    space[s * stride : (s + 1) * stride] = record
                    rows.append((r["slots"][i], shard, s * stride, r["sequence_ids"][i], r["n_tokens"][i], r["doc_ids"][i], zlib.crc32(record)))
        if shard is None:
            return
        store, root = fs.FileSystem.from_uri(self.out_dir)
        store.create_dir(root, recursive=True)
        draft = f"{root}/draft-{shard:08d}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as sink:
            sink.write(space)
        store.move(draft, f"{root}/shard-{shard:08d}.bin")
        rows.sort()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        names = ["slot", "shard", "byte_offset", "sequence_id", "n_tokens", "doc_ids", "crc32"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_slots(out_dir: str, start: int, stop: int, length: int = SEQUENCE_TOKENS, records: int = SHARD_RECORDS) -> Iterator[np.ndarray]:
    """The sequences of slots start..stop-1 in order, for a reader that resumes at any slot."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out_dir)
    stride = length * TOKEN_BYTES
    at = start
    while at < stop:
        shard, skip = divmod(at, records)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(skip * stride)
            for _ in range(min(stop - at, records - skip)):
                yield np.frombuffer(f.read(stride), "<u2")
                at += 1
