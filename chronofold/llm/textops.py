"""Array operations on whole batches of texts: words, hashes, shingles.

Texts are handled as one UTF-8 byte array with offsets, the layout that Arrow has anyway. Bytes from 0x80 on belong to
characters beyond ASCII, so a class of ASCII separators splits bytes exactly as it splits characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
RADIX = 0x9E3779B97F4A7C15
RADIX_INV = pow(RADIX, -1, 1 << 64)
#: Bytes of a long text, or entries of its arrays, that are worked on at a time.
WINDOW = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Everything but space and \t..\r.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Lower-case letters, digits and all characters beyond ASCII.
ALNUM_LOWER = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each (a longer text stands alone), so that work arrays stay in cache."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one more entry: the number of words)."""
    starts, ends = [], []
    for lo in range(0, len(data) + 1, WINDOW):
        hi = min(lo + WINDOW, len(data) + 1)
        a, b = max(lo - 1, 0), min(hi, len(data))
        flag = np.zeros(hi - lo + 1, bool)  # of the bytes lo - 1 .. hi - 1; those outside are in no word
        flag[a - lo + 1 : b - lo + 1] = in_word[data[a:b]]
        cut = np.zeros(hi - lo, bool)
        cut[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo] = True
        starts.append(lo + np.flatnonzero(flag[1:] & (~flag[:-1] | cut)))
        ends.append(lo + np.flatnonzero(flag[:-1] & (~flag[1:] | cut)))
    start, end = np.concatenate(starts), np.concatenate(ends)
    return start, end, np.searchsorted(start, offsets)


def span_windows(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs lo..hi of spans, which stand in order, that lie in one window each. A longer span stands alone."""
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + WINDOW, "right")))
        yield lo, hi
        lo = hi


def table_counts(table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span, which stand in order, belong to a byte class."""
    out = np.zeros(len(start), np.int64)
    for lo, hi in span_windows(start, end):
        base, stop = int(start[lo]), int(end[hi - 1])
        if stop - base > WINDOW:
            out[lo] = sum(int(np.count_nonzero(table[data[at : min(at + WINDOW, stop)]])) for at in range(base, stop, WINDOW))
        else:
            total = np.zeros(stop - base + 1, np.int64)
            np.cumsum(table[data[base:stop]], out=total[1:])
            out[lo:hi] = total[end[lo:hi] - base] - total[start[lo:hi] - base]
    return out


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", RADIX), ("down", RADIX_INV)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes, each times its power."""
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * _powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of prefix sums. Spans stand in order and don't overlap; sums are taken in windows, so memory follows the number of spans."""
    out = np.zeros(len(start), U64)
    for lo, hi in span_windows(start, end):
        base, stop = int(start[lo]), int(end[hi - 1])
        if stop - base > WINDOW:
            total = sum(int(_sums(data[at : min(at + WINDOW, stop)])[-1]) * pow(RADIX, at - base, 1 << 64) for at in range(base, stop, WINDOW))
            out[lo] = total % (1 << 64)
        else:
            sums, down = _sums(data[base:stop]), _powers(stop - base + 1)[1]
            with np.errstate(over="ignore"):
                out[lo:hi] = (sums[end[lo:hi] - base] - sums[start[lo:hi] - base]) * down[start[lo:hi] - base]
    with np.errstate(over="ignore"):
        return _mixed(out + (end - start).astype(U64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` in place, a window at a time."""
    for at in range(0, len(x), WINDOW):
        x[at : at + WINDOW] = mix(x[at : at + WINDOW])
    return x


def gram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive token hashes; runs across texts are the caller's to drop."""
    n = max(0, len(tokens) - k + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for i in range(k):
            out *= U64(RADIX)
            out += tokens[i : i + n]
    return _mixed(out)


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose words begin at ``first`` (n + 1 entries): the start word of each k-gram within a text, and how many each text has."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return base + np.arange(counts.sum()), counts


def long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)
