"""Hierarchical packing of documents into token sequences of several lengths.

Each document is routed by length to the smallest tier that holds it (what exceeds the longest tier is cut off in whole
sequences of that length first). Tiers are packed from the longest down: a sequence starts with a document of its own
tier, its gap is filled with the largest fitting pieces of shorter tiers, and the last gap by cutting one, so that every
sequence but the last of a task is exactly as long as its tier. Sequences of one tier are then dealt to step groups, of
equal tokens each, so that their attention cost is even.

A task packs its own input split through a bounded window, so nothing is shuffled and memory doesn't grow with the data;
each task leaves at most one sequence that needs padding.

Defined cases: a null text is empty and yields the end-of-document id alone; a text of any length is encoded whole, and what
it fills leaves in sequences of its own; the string of an added token gets that token's id; repeated rows are packed once
each; rows with a null doc_id keep it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chronofold.llm import tokens

TIERS = (256, 512, 1024, 2048)
#: Pieces held before they are packed.
WINDOW = 2048
END_OF_DOCUMENT = 1
STEP_TOKENS = 1 << 16
#: Step groups filled at a time.
GROUPS_AT_A_TIME = 4


class _Packer:
    """Pieces are (length, serial, doc, start, ids, total), ids as bytes of 4 each."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tuple(sorted(tiers))
        self.pools: list[list[tuple]] = [[] for _ in self.tiers]
        self.held = 0
        self._serial = 0

    def _pool(self, doc, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        level = next(i for i, t in enumerate(self.tiers) if n <= t)
        self._serial += 1
        insort(self.pools[level], (n, self._serial, doc, start, ids, total))
        self.held += 1

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, list[tuple]]]:
        """Takes a document; yields the (tier, pieces) of sequences that it fills by itself."""
        top, total = self.tiers[-1], len(ids) // 4
        cut = total - total % top
        for at in range(0, cut, top):
            self._serial += 1
            yield top, [(top, self._serial, doc, at, ids[4 * at : 4 * (at + top)], total)]
        if cut < total:
            self._pool(doc, cut, ids[4 * cut :], total)

    def _fit(self, below: int, gap: int) -> tuple | None:
        """The largest piece of at most ``gap`` ids in the pools up to ``below``."""
        best = None
        for level in range(below, -1, -1):
            pool = self.pools[level]
            at = bisect_right(pool, gap, key=lambda p: p[0]) - 1
            if at >= 0 and (best is None or pool[at][0] > best[0]):
                best = (pool[at][0], level, at)
        if best is None:
            return None
        self.held -= 1
        return self.pools[best[1]].pop(best[2])

    def _split(self, below: int, gap: int) -> tuple | None:
        """The first ``gap`` ids of a piece of the shortest pool; the rest goes back."""
        for level in range(below + 1):
            if self.pools[level]:
                n, serial, doc, start, ids, total = self.pools[level].pop()
                self.held -= 1
                self._pool(doc, start + gap, ids[4 * gap :], total)
                return gap, serial, doc, start, ids[: 4 * gap], total
        return None

    def pack(self, last: bool = False) -> Iterator[tuple[int, list[tuple]]]:
        """Packs what is held; what doesn't fill a sequence waits, or at the end is the sequence to pad."""
        for level in range(len(self.tiers) - 1, -1, -1):
            while self.pools[level]:
                inside = [self.pools[level].pop()]
                self.held -= 1
                gap = self.tiers[level] - inside[0][0]
                while gap:
                    piece = self._fit(level, gap) or self._split(level, gap)
                    if piece is None:
                        break
                    inside.append(piece)
                    gap -= piece[0]
                if not gap:
                    yield self.tiers[level], inside
                elif last:
                    yield self.tiers[-1], inside
                else:
                    for n, _, doc, start, ids, total in inside:
                        self._pool(doc, start, ids, total)
                    return


class _Groups:
    """Deals sequences of each tier to step groups, the costliest first, back and forth."""

    def __init__(self, step_tokens: int, base: int) -> None:
        self.step_tokens, self.next = step_tokens, base
        self.held: dict[int, list[list[tuple]]] = {}

    def put(self, tier: int, inside: list[tuple]) -> Iterator[tuple[int, int, list[tuple]]]:
        held = self.held.setdefault(tier, [])
        held.append(inside)
        if len(held) >= GROUPS_AT_A_TIME * max(1, self.step_tokens // tier):
            yield from self.deal(tier)

    def deal(self, tier: int) -> Iterator[tuple[int, int, list[tuple]]]:
        held = sorted(self.held.pop(tier), key=lambda s: -sum(p[0] ** 2 for p in s))
        n = -(-len(held) // max(1, self.step_tokens // tier))
        for i, inside in enumerate(held):
            lap, at = divmod(i, n)
            yield self.next + (at if lap % 2 == 0 else n - 1 - at), tier, inside
        self.next += n

    def rest(self) -> Iterator[tuple[int, int, list[tuple]]]:
        for tier in sorted(self.held):
            yield from self.deal(tier)


def packed(batches: Iterator[pa.RecordBatch], tiers: tuple[int, ...], step_tokens: int, window: int, paths: tuple[str, str], base: int | None = None) -> Iterator[tuple[int, int, int, list[tuple]]]:
    """(sequence_id, step_group, tier, pieces) of some documents. Ids are unique over tasks: ``base``, else the task's number, stands above 2**36."""
    from pyspark import TaskContext

    base = (TaskContext.get().partitionId() if base is None else base) << 36
    encode, packer, groups = tokens.encoder(paths).encode, _Packer(tiers), _Groups(step_tokens, base)
    end = END_OF_DOCUMENT.to_bytes(4, "little")
    number = base

    def numbered(sequences):
        nonlocal number
        for tier, inside in sequences:
            for group, t, s in groups.put(tier, inside):
                yield number, group, t, s
                number += 1

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            yield from numbered(packer.add(doc, encode(text.as_py() or "") + end))
            if packer.held >= window:
                yield from numbered(packer.pack())
    yield from numbered(packer.pack(last=True))
    for group, t, s in groups.rest():
        yield number, group, t, s
        number += 1


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, window: int = WINDOW, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, text -> a row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier, step_group."""
    paths = paths or tokens.default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for number, group, tier, inside in packed(batches, tiers, step_tokens, window, paths):
            at = 0
            for n, _, doc, start, ids, total in inside:
                rows.append((doc, start, n, ids, total, number, at, tier, group))
                at += n
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long")
