"""SentencePiece-style encoding by unigram Viterbi, and decoding.

The pieces and their ids are those of a given file and stay as they are. Their log scores are estimated on the corpus by
expectation maximisation: Spark counts the distinct units of all texts, each step runs forward and backward over the
segmentations of every unit, weighted by its count, and sums the expected uses of each piece over all partitions; the driver
only sees one number a piece. (The file at hand is a BPE model, whose scores are merge ranks, not log probabilities.)

Pieces stand in a double-array trie over UTF-8 bytes. White space becomes the marker U+2581, one is put
in front of a text, and the segmentation with the highest sum of scores is found by dynamic programming; a character that no
piece covers costs ``UNKNOWN_PENALTY`` below the lowest score and is written as its bytes' pieces. Where two segmentations tie,
the one whose last piece is longer wins, at every place.

No piece crosses from another character into a marker, so a text splits before each run of markers into units that are solved
on their own. The distinct units of a batch are solved together, the trie walked and the sums carried on arrays, and the
most recent units are remembered by the worker; a long unit is solved by itself, edge by edge.

Defined cases: a null text is empty and has no ids; a text of any length, with or without spaces, is encoded whole, in time and
memory in proportion to it; U+2581 in a text decodes as a space; invalid ids raise an error;
repeated rows are encoded alike and count each; a null doc_id is kept as it is; without any text all pieces score
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import textops
from chronofold.scratch import Scratch

MARK = "▁"
MARK_BYTES = MARK.encode()
UNKNOWN_PENALTY = 10.0
#: Units that a worker remembers, and how long they may be.
CACHE_UNITS = 400_000
CACHE_CHARS = 48
#: Bytes from which a unit is solved by itself.
LONG_UNIT = 256
#: Steps of expectation maximisation, and what is added to each piece's expected uses.
EM_STEPS = 4
EM_SMOOTHING = 0.01
#: Units solved together, of about equal lengths: few enough that their edges stay in the processor's cache.
SOLVED_UNITS = 2000
#: Bytes of texts whose units a task counts together (a longer text stands alone), and distinct units that it passes on at once.
COUNTED_CHARS = 16 << 20
PASSED_UNITS = 100_000
#: Ids of texts decoded together (a longer text stands alone).
DECODED_IDS = 1 << 20
#: Bytes of units solved together, if they aren't one.
SOLVED_BYTES = 1 << 18
#: Bytes below which sums over the segmentations of a unit are made of probabilities, not of their logarithms.
LINEAR_UNIT = 64
#: Sums of such a unit, scaled, that count as exact.
LEAST_SUM, MOST_SUM = 1e-250, 1e250
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Pieces:
    """What a vocabulary says: text, log score, and kind of each id."""

    texts: tuple[str, ...]
    scores: np.ndarray
    usable: np.ndarray
    bytes_at: np.ndarray

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        texts = tuple(sp.id_to_piece(i) for i in ids)
        usable = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids])
        bytes_at = np.full(256, -1, np.int64)
        for i in ids:
            if sp.is_byte(i):
                bytes_at[int(texts[i][3:5], 16)] = i
        return cls(texts, np.array([sp.get_score(i) for i in ids], float), usable, bytes_at)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArrayTrie:
    """State s goes by byte c to t = base[s] + c + 1 if check[t] == s; piece[t] is the id that ends there, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys:
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = value
        size = 3 * len(children) + 1024
        base, check, piece, taken = [0] * size, [-1] * size, [-1] * size, bytearray(size)
        taken[0] = 1
        todo, free, front = [(0, 0)], 1, 0  # lone children fill holes from ``free`` on, siblings look for room from ``front`` on
        while todo:
            node, state = todo.pop()
            piece[state] = ends[node]
            labels = sorted(children[node])
            if not labels:
                continue
            if len(labels) == 1:
                while taken[free] or free <= labels[0]:
                    free += 1
                at = free - labels[0] - 1
            else:
                at = front
                while any(taken[at + c + 1] for c in labels):
                    at += 1
                front = max(front, at - 64)
            base[state] = at
            for c in labels:
                taken[at + c + 1], check[at + c + 1] = 1, state
                todo.append((children[node][c], at + c + 1))
        self.base, self.check, self.piece = (np.array(x, np.int32) for x in (base, check, piece))

    def matches(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``start``, end byte, id) of every piece that begins at a start and ends by its end."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        who, state, at = np.arange(len(start)), np.zeros(len(start), np.int64), start.copy()
        while len(who):
            go = at < end[who]
            who, state, at = who[go], state[go], at[go]
            to = self.base[state] + data[at].astype(np.int64) + 1
            go = self.check[to] == state
            who, state, at = who[go], to[go], at[go] + 1
            done = self.piece[state] >= 0
            if done.any():
                found.append((who[done], at[done], self.piece[state[done]].astype(np.int64)))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))


@dataclass(frozen=True)
class _Lattice:
    """Edges of the segmentations of some units: from byte ``begin`` to ``end`` by ``piece`` (-1: a bare character) of unit ``owner``, which starts at byte ``first``."""

    data: np.ndarray
    first: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    owner: np.ndarray
    gain: np.ndarray


class UnigramModel:
    def __init__(self, pieces: Pieces, trie: DoubleArrayTrie | None = None) -> None:
        for t, ok in zip(pieces.texts, pieces.usable, strict=True):
            if ok and MARK in t.lstrip(MARK):
                raise ValueError(f"a piece crosses into a marker: {t!r}")
        self.pieces = pieces
        self.trie = trie or DoubleArrayTrie([(t.encode(), i) for i, (t, ok) in enumerate(zip(pieces.texts, pieces.usable, strict=True)) if ok])
        self.unknown = float(pieces.scores[pieces.usable].min()) - UNKNOWN_PENALTY
        self._cache: dict[str, bytes] = {}
        self._raw: pa.Array | None = None

    def _lattice(self, raw: list[bytes]) -> _Lattice:
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        unit = np.repeat(np.arange(len(raw)), size)[lead]
        who, end, piece = self.trie.matches(data, lead, (first + size)[unit])
        after = np.append(lead[1:], len(data))
        whole = np.zeros(len(lead), bool)
        whole[who[end == after[who]]] = True
        bare = np.flatnonzero(~whole)
        begin, end, piece = np.concatenate([lead[who], lead[bare]]), np.concatenate([end, after[bare]]), np.concatenate([piece, np.full(len(bare), -1)])
        gain = np.where(piece >= 0, self.pieces.scores[piece], self.unknown)
        return _Lattice(data, first, size, begin, end, piece, np.repeat(np.arange(len(raw)), size)[begin], gain)

    def solve(self, units: list[str]) -> list[bytes]:
        """The best ids of each unit, as little-endian 32-bit values."""
        raw = [u.encode() for u in units]
        short = [i for i, r in enumerate(raw) if len(r) < LONG_UNIT]
        out = [b""] * len(raw)
        for i, ids in zip(short, self._solve_together([raw[i] for i in short]) if short else (), strict=True):
            out[i] = ids
        for i, r in enumerate(raw):
            if len(r) >= LONG_UNIT:
                out[i] = self._solve_long(r)
        return out

    def _solve_long(self, raw: bytes) -> bytes:
        x = self._lattice([raw])
        order = np.lexsort((x.begin, x.end))
        begin, end, gain, piece = (c[order].tolist() for c in (x.begin, x.end, x.gain, x.piece))
        best, back = [-math.inf] * (len(raw) + 1), [-1] * (len(raw) + 1)
        best[0] = 0.0
        for i, (b, e, g) in enumerate(zip(begin, end, gain, strict=True)):
            if best[b] + g > best[e]:  # of equal sums the earliest beginning stays
                best[e], back[e] = best[b] + g, i
        ids: list[int] = []
        at = len(raw)
        while at:
            i = back[at]
            ids += [piece[i]] if piece[i] >= 0 else self._bytes(x.data[begin[i] : end[i]])[::-1].tolist()
            at = begin[i]
        return np.array(ids[::-1], "<i4").tobytes()

    def _solve_together(self, raw: list[bytes]) -> list[bytes]:
        x = self._lattice(raw)
        data, first, size, gain, piece, owner = x.data, x.first, x.size, x.gain, x.piece, x.owner
        # a sum for each byte bound of each unit: unit u has bounds first[u] + u .. first[u] + u + size[u]
        src, dst = x.begin + owner, x.end + owner
        best = np.full(len(data) + len(raw), -np.inf)
        back = np.full(len(best), -1, np.int64)
        best[first + np.arange(len(raw))] = 0.0
        step = x.end - first[owner]
        order = np.argsort((step << 48) + (dst << 9) - (x.end - x.begin))  # by step, then end, then beginning; units are shorter than 2**8 bytes
        src, dst, gain, step, piece, owner = src[order], dst[order], gain[order], step[order], piece[order], owner[order]
        cuts = np.flatnonzero(np.diff(step)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(step)], strict=True) if len(step) else ():
            sums, to = best[src[lo:hi]] + gain[lo:hi], dst[lo:hi]
            heads = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1))
            top = np.maximum.reduceat(sums, heads)
            wins = np.flatnonzero(sums == np.repeat(top, np.diff(np.append(heads, len(to)))))
            one = to[heads]
            best[one], back[one] = top, lo + wins[np.searchsorted(wins, heads)]  # the earliest beginning, so the longest last piece
        # all units are followed back at once; places fall, so the edges of a unit come last first
        home = first + np.arange(len(raw))
        at, live = home + size, np.arange(len(raw))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            edge = back[at]
            steps.append((live, edge))
            at = src[edge]
            go = at > home[live]
            at, live = at[go], live[go]
        unit, edge = (np.concatenate(x)[::-1] for x in zip(*steps, strict=True))
        order = np.argsort(unit, kind="stable")
        unit, edge = unit[order], edge[order]
        ids, width = piece[edge], np.ones(len(edge), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            width[unknown] = (dst - src)[edge[unknown]]
            where = np.concatenate(([0], np.cumsum(width)[:-1]))
            ids = np.repeat(ids, width)
            for e, w, n in zip(edge[unknown], where[unknown], width[unknown], strict=True):
                lo = src[e] - owner[e]
                ids[w : w + n] = self._bytes(data[lo : lo + n])
        bounds = np.concatenate(([0], np.cumsum(np.bincount(unit, width, len(raw)).astype(np.int64)))).tolist()
        buffer = ids.astype("<i4").tobytes()
        return [buffer[4 * lo : 4 * hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]

    def expected_uses(self, units: list[str], counts: np.ndarray) -> tuple[np.ndarray, float]:
        """How often each piece is used in the segmentations of the units, each weighted by its probability and its unit's count; and the log likelihood."""
        raw = [u.encode() for u in units]
        size = np.array([len(r) for r in raw], np.int64)
        uses, likelihood = np.zeros(len(self.pieces.texts)), 0.0
        some = np.flatnonzero(size < LINEAR_UNIT)
        if len(some):
            more, likelihood, left = self._linear_uses(self._lattice([raw[i] for i in some]), counts[some])
            uses += more
            some = some[left]
        short = np.sort(np.concatenate([some, np.flatnonzero((size >= LINEAR_UNIT) & (size < LONG_UNIT))]))
        parts = [(self._lattice([raw[i] for i in short]), counts[short], self._sums_together)] if len(short) else []
        long = ((self._lattice([raw[i]]), counts[i : i + 1], self._sums_long) for i in np.flatnonzero(size >= LONG_UNIT))  # one at a time
        for x, n, sums in chain(parts, long):
            before, after, whole = sums(x)  # log sums up to each edge's begin, from its end on, and of its unit
            weight = np.exp(before + x.gain + after - whole[x.owner]) * n[x.owner]
            named = x.piece >= 0
            uses += np.bincount(x.piece[named], weight[named], len(uses))
            likelihood += float(whole @ n)
        return uses, likelihood

    def _linear_uses(self, x: _Lattice, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """``expected_uses`` of short units, place by place for all of them; and which units' sums left the range of doubles, so that they don't count here.

        Every byte's share is scaled by the same factor, by which the sums of a usual unit come near 1.
        """
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            return self._scaled_uses(x, counts)

    def _scaled_uses(self, x: _Lattice, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        n, width = len(x.first), int(x.size.max())
        begin, end = (x.begin - x.first[x.owner]).astype(np.uint8), (x.end - x.first[x.owner]).astype(np.uint8)
        a_byte = -float(np.median(x.gain / (x.end - x.begin)))
        weight = np.exp(x.gain + a_byte * (x.end - x.begin))
        forward, backward = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        forward[0] = 1.0
        backward[x.size, np.arange(n)] = 1.0
        for sums, start, to, places in ((forward, begin, end, range(1, width + 1)), (backward, end, begin, range(width - 1, -1, -1))):
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(width + 2))
            start, own, share = start[order], x.owner[order], weight[order]
            for p in places:
                at = slice(cuts[p], cuts[p + 1])
                if at.start < at.stop:
                    sums[p] += np.bincount(own[at], sums[start[at], own[at]] * share[at], n)
        whole = forward[x.size, np.arange(n)]
        good = (whole > LEAST_SUM) & (whole < MOST_SUM) & (forward.max(axis=0) < MOST_SUM) & (backward.max(axis=0) < MOST_SUM)
        expected = forward[begin, x.owner] * weight * backward[end, x.owner] * (np.where(good, counts, 0.0) / np.where(good, whole, 1.0))[x.owner]
        named = (x.piece >= 0) & good[x.owner]
        likelihood = float((np.log(whole[good]) - a_byte * x.size[good]) @ counts[good])
        return np.bincount(x.piece[named], expected[named], len(self.pieces.texts)), likelihood, np.flatnonzero(~good)

    @staticmethod
    def _sums_together(x: _Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x.first)
        src, dst, home = x.begin + x.owner, x.end + x.owner, x.first + np.arange(n)
        forward, backward = (np.full(len(x.data) + n, -np.inf) for _ in range(2))
        forward[home] = backward[home + x.size] = 0.0

        def carry(sums: np.ndarray, start: np.ndarray, to: np.ndarray, step: np.ndarray) -> None:
            order = np.argsort((step << 40) + to)
            start, to, step, gain = start[order], to[order], step[order], x.gain[order]
            cuts = np.flatnonzero(np.diff(step)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(step)], strict=True) if len(step) else ():
                terms = sums[start[lo:hi]] + gain[lo:hi]
                heads = np.concatenate(([0], np.flatnonzero(np.diff(to[lo:hi])) + 1))
                top = np.maximum.reduceat(terms, heads)
                rest = np.exp(terms - np.repeat(top, np.diff(np.append(heads, hi - lo))))
                sums[to[lo:hi][heads]] = top + np.log(np.add.reduceat(rest, heads))

        carry(forward, src, dst, x.end - x.first[x.owner])
        carry(backward, dst, src, (x.first + x.size)[x.owner] - x.begin)
        return forward[src], backward[dst], forward[home + x.size]

    @staticmethod
    def _sums_long(x: _Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def carry(start: np.ndarray, to: np.ndarray, order: np.ndarray, origin: int) -> np.ndarray:
            sums = [-math.inf] * (len(x.data) + 1)
            sums[origin] = 0.0
            for a, b, g in zip(start[order].tolist(), to[order].tolist(), x.gain[order].tolist(), strict=True):
                one, other = sums[b], sums[a] + g
                high, low = (one, other) if one > other else (other, one)
                sums[b] = high + math.log1p(math.exp(low - high)) if low > -math.inf else high
            return np.array(sums)

        forward = carry(x.begin, x.end, np.argsort(x.end, kind="stable"), 0)
        backward = carry(x.end, x.begin, np.argsort(-x.begin, kind="stable"), len(x.data))
        return forward[x.begin], backward[x.end], forward[-1:]

    def _bytes(self, raw: np.ndarray) -> np.ndarray:
        ids = self.pieces.bytes_at[raw]
        if (ids < 0).any():
            raise ValueError("the vocabulary has no piece for a byte")
        return ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit values."""
        return self.encode_column(pa.array(texts, pa.large_string())).to_pylist()

    def encode_column(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """``encode_batch`` of a column; nulls are empty."""
        units, first = split_units(texts)
        if not len(units):
            return pa.array([b""] * len(texts), pa.large_binary())
        if len(self._cache) > CACHE_UNITS:
            self._cache.clear()
        units = units.dictionary_encode()
        distinct = units.dictionary.to_pylist()
        new = sorted((u for u in distinct if u not in self._cache), key=len)
        for at in range(0, len(new), SOLVED_UNITS):
            some = new[at : at + SOLVED_UNITS]
            self._cache.update(zip(some, self.solve(some), strict=True))
        _, bounds, data = pa.array(map(self._cache.__getitem__, distinct), pa.large_binary()).take(units.indices).buffers()
        for u in reversed(new):  # by length
            if len(u) <= CACHE_CHARS:
                break
            del self._cache[u]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.frombuffer(bounds, np.int64)[first]), data])

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: pieces and bytes are joined, markers become spaces, the one in front goes."""
        return self.decode_parts(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_parts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """``decode`` of each part between two bounds."""
        if self._raw is None:
            raw = [t.encode() if ok else None for t, ok in zip(self.pieces.texts, self.pieces.usable, strict=True)]
            for b, i in enumerate(self.pieces.bytes_at):
                if i >= 0:
                    raw[i] = bytes([b])
            self._raw = pa.array(raw, pa.large_binary())
        if not len(ids):
            return [""] * (len(bounds) - 1)
        if not 0 <= ids.min() <= ids.max() < len(self._raw):
            raise ValueError("an id is out of range")
        found = self._raw.take(pa.array(ids))
        if found.null_count:
            raise ValueError("a control piece has no text")
        _, at, data = found.buffers()
        at = np.frombuffer(at, np.int64)[bounds].tolist()
        texts = (str(data[lo:hi], "utf-8", "replace").replace(MARK, " ") for lo, hi in zip(at[:-1], at[1:], strict=True))
        return [t[1:] if t.startswith(" ") else t for t in texts]


def units_of(text: str) -> list[str]:
    return _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []


def split_units(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """``units_of`` all texts in one array over their bytes, and the first one of each text (one more entry: their number). Nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    marked = pc.replace_substring(texts, " ", MARK)
    marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string())))
    data, offsets = textops.text_bytes(marked)
    at = np.flatnonzero(data[:-2] == MARK_BYTES[0]) if len(data) else np.zeros(0, np.int64)
    at = at[(data[at + 1] == MARK_BYTES[1]) & (data[at + 2] == MARK_BYTES[2])]
    begins = np.ones(len(at), bool)
    begins[1:] = np.diff(at) > len(MARK_BYTES)
    begins[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True  # each text that isn't empty begins with a marker, wherever the one before ends
    at = at[begins]
    bounds = np.append(at, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data)), np.searchsorted(at, offsets)


_MODELS: dict[str, UnigramModel] = {}
_SCORED: dict[tuple[str, bytes], UnigramModel] = {}


def model(path: str, scores: bytes | None = None) -> UnigramModel:
    """One model a process and file; with other ``scores`` (doubles, as bytes) the last one for each file."""
    if path not in _MODELS:
        _MODELS[path] = UnigramModel(Pieces.load(path))
    if scores is None:
        return _MODELS[path]
    if (path, scores) not in _SCORED:
        _SCORED.clear()
        plain = _MODELS[path]
        _SCORED[path, scores] = UnigramModel(replace(plain.pieces, scores=np.frombuffer(scores, float)), plain.trie)
    return _SCORED[path, scores]


def unit_counts(docs: DataFrame) -> DataFrame:
    """unit, n: how often each unit stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            column = b.column("text")
            size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for lo, hi in textops.pieces(np.concatenate(([0], np.cumsum(size, dtype=np.int64))), COUNTED_CHARS):
                found = split_units(column.slice(lo, hi - lo))[0].value_counts()
                for at in range(0, len(found), PASSED_UNITS):
                    unit, n = found.slice(at, PASSED_UNITS).flatten()
                    yield pa.RecordBatch.from_arrays([unit.cast(pa.string()), n], names=["unit", "n"])

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def _uses(units: DataFrame, path: str, scores: bytes) -> tuple[np.ndarray, float]:
    """Expected uses of each piece and the log likelihood, summed over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, scores)
        total, likelihood = np.zeros(len(m.pieces.texts)), 0.0
        for whole in textops.long_rows(batches):
            size = pc.binary_length(whole.column("unit")).to_numpy()
            order = np.argsort(size, kind="stable")
            ends = np.concatenate(([0], np.cumsum(size[order], dtype=np.int64)))
            for lo, hi in textops.pieces(ends, SOLVED_BYTES):
                for at in range(lo, hi, SOLVED_UNITS):
                    b = whole.take(pa.array(order[at : min(hi, at + SOLVED_UNITS)]))
                    uses, more = m.expected_uses(b.column("unit").to_pylist(), b.column("n").to_numpy().astype(float))
                    total += uses
                    likelihood += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], likelihood))], names=["id", "uses"])

    found = units.mapInArrow(run, "id int, uses double").groupBy("id").agg(F.sum("uses").alias("uses")).collect()  # a row a piece
    out = np.zeros(len(np.frombuffer(scores, float)))
    for r in found:
        if r["id"] >= 0:
            out[r["id"]] = r["uses"]
    return out, sum(r["uses"] for r in found if r["id"] < 0)


def estimate_scores(docs: DataFrame, path: str | None = None, steps: int = EM_STEPS) -> DataFrame:
    """id, piece, score (its log probability), log_likelihood (of the corpus before the last step): saved, a row a piece of the file."""
    path = path or default_path()
    scratch = Scratch(docs.sparkSession)
    units = scratch.save(unit_counts(docs), "units")
    pieces = model(path).pieces
    scores, likelihood = np.where(pieces.usable, -math.log(max(1, pieces.usable.sum())), 0.0), 0.0
    for _ in range(steps):
        uses, likelihood = _uses(units, path, scores.tobytes())
        uses = np.where(pieces.usable, uses + EM_SMOOTHING, 0.0)
        scores = np.zeros(len(uses))
        scores[pieces.usable] = np.round(np.log(uses[pieces.usable] / uses.sum()), 6)  # sums differ in their last digits with the order of partitions
    scratch.drop(units)
    rows = pa.table({"id": pa.array(np.arange(len(scores)), pa.int32()), "piece": pa.array(pieces.texts), "score": pa.array(scores), "log_likelihood": pa.array(np.full(len(scores), likelihood))})
    return scratch.save(docs.sparkSession.createDataFrame(rows), "scores")


def _array(scores: DataFrame | None) -> bytes | None:
    if scores is None:
        return None
    found = scores.select("id", "score").toArrow()  # a row a piece
    out = np.zeros(found.num_rows)
    out[found.column("id").to_numpy()] = found.column("score").to_numpy()
    return out.tobytes()


def _encoded(batches: Iterator[pa.RecordBatch], path: str, scores: bytes | None, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    m = model(path, scores)
    is_byte = np.zeros(len(m.pieces.texts), bool)
    is_byte[m.pieces.bytes_at[m.pieces.bytes_at >= 0]] = True
    for whole in textops.long_rows(batches):
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            coded = m.encode_column(b.column("text"))
            ids, bounds = _flat_ids(coded)
            of_bytes = np.concatenate(([0], np.cumsum(is_byte[ids])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), coded.cast(pa.binary()), pa.array(np.diff(bounds)), pa.array(np.diff(of_bytes[bounds]))], names=["doc_id", "ids", "n_ids", "n_byte_ids"])


def _flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of them, and the bounds of its rows; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[0] == off[-1]:
        return np.zeros(0, "<i4"), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<i4"), (off - off[0]) // 4


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for b in batches:
        ids, bounds = _flat_ids(b.column("ids"))
        texts = [t for lo, hi in textops.pieces(bounds, DECODED_IDS) for t in m.decode_parts(ids[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])]
        yield b.append_column("text", pc.if_else(b.column("ids").is_valid(), pa.array(texts, pa.string()), None))


_SCHEMA = "doc_id long, ids binary, n_ids long, n_byte_ids long"


def encode_documents(docs: DataFrame, path: str | None = None, scores: DataFrame | None = None) -> DataFrame:
    """doc_id, text -> doc_id, ids (little-endian 32-bit), n_ids, n_byte_ids (pieces of single bytes). ``scores``: as ``estimate_scores`` gives them; else the file's."""
    path, values = path or default_path(), _array(scores)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(batches, path, values), _SCHEMA)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``text``, decoded, to the rows of ``encode_documents``."""
    path = path or default_path()
    return encoded.mapInArrow(lambda batches: _decoded(batches, path), f"{_SCHEMA}, text string")


def round_trip(docs: DataFrame, path: str | None = None, scores: DataFrame | None = None) -> DataFrame:
    """``decode_documents`` of ``encode_documents`` in one pass of one worker: the ids and the text that they give."""
    path, values = path or default_path(), _array(scores)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _decoded(_encoded(batches, path, values), path), f"{_SCHEMA}, text string")
