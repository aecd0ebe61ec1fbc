"""Counts and shares of whole texts, computed for a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from chronofold.llm import textops
from chronofold.llm.textops import U64

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = textops.byte_class((65, 90))
DIGIT = textops.byte_class((48, 57))
PUNCTUATION = textops.byte_class((33, 47), (58, 64), (91, 96), (123, 126))
SENTENCE_END = textops.byte_class((33, 33), (46, 46), (63, 63))
NOT_CONTINUED = ~textops.byte_class((0x80, 0xBF))
WIDE = textops.byte_class((128, 255))
NEW_LINE = 10


#: Keys that are sorted at a time.
SORTED = 1 << 20


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) == 2:
        return np.array([np.count_nonzero(flags[bounds[0] : bounds[1]])])
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _by_top_bits(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the keys, those of equal keys together, in parts that are sorted for themselves."""
    bits = int(len(keys) // SORTED).bit_length()
    if not bits:
        yield np.arange(len(keys))
        return
    for part in range(1 << bits):
        yield np.flatnonzero(keys >> U64(64 - bits) == U64(part))


def _own(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that differ between rows."""
    with np.errstate(over="ignore"):
        return keys ^ textops.mix(np.arange(1, int(row[-1]) + 2, dtype=U64))[row]


def _repeated(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which keys occur more than once in their row."""
    out = np.zeros(len(keys), bool)
    if not len(keys):
        return out
    own = _own(keys, row)
    for at in _by_top_bits(own):
        at = at[np.argsort(own[at])]
        same = own[at[1:]] == own[at[:-1]]
        out[at[1:][same]] = True
        out[at[:-1][same]] = True
    return out


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    out = np.zeros(n, np.int64)
    if not len(keys):
        return out
    own = _own(keys, row)
    for at in _by_top_bits(own):
        _, first = np.unique(own[at], return_index=True)
        out += np.bincount(row[at[first]], minlength=n)
    return out


class TextFacts:
    """Words and lines of some rows of a batch, with their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.start, self.end, self.first = textops.words(data, offsets, textops.NOT_SPACE)
        self.n_words = np.diff(self.first)
        self.word_row = np.repeat(np.arange(self.n), self.n_words)
        self.hashes = textops.span_hashes(data, self.start, self.end)

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of a class in each text."""
        return textops.table_counts(table, self.data, self.offsets[:-1], self.offsets[1:])

    def repeat_words(self) -> np.ndarray:
        """Words that stand in a 3-word window which their text has twice or more."""
        at, counts = textops.gram_starts(self.first, 3)
        again = at[_repeated(textops.gram_hashes(self.hashes, 3)[at], np.repeat(np.arange(self.n), counts))]
        covered = np.zeros(len(self.hashes), bool)
        for i in range(3):
            covered[again + i] = True
        return _sums(covered, self.first)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier one, of each row."""
        cut = np.flatnonzero(self.data == NEW_LINE)
        start = np.union1d(cut + 1, self.offsets[:-1])
        start = start[start < len(self.data)]
        if not len(start):
            return np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        row = np.searchsorted(self.offsets, start, "right") - 1
        next_cut = np.append(cut, len(self.data))[np.searchsorted(cut, start)]
        end = np.minimum(next_cut, self.offsets[row + 1])
        full = np.searchsorted(self.start, start) < np.searchsorted(self.start, end)
        start, end, row = start[full], end[full], row[full]
        n_lines = np.bincount(row, minlength=self.n)
        return n_lines, n_lines - _distinct(textops.span_hashes(self.data, start, end), row, self.n)

    def base(self) -> dict[str, np.ndarray]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        return {"n_words": self.n_words, "word_chars": self.count(textops.NOT_SPACE & NOT_CONTINUED), "n_symbols": self.count(SYMBOLS), "n_dup_lines": self.lines()[1], "n_repeat_words": self.repeat_words()}


#: Names of the statistics that the quality classifier sees.
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "punctuation", "symbol", "wide", "white", "line_words",
    "dup_lines", "repeat_words", "distinct_words", "next_equal", "upper_words", "symbol_ends", "short_words", "long_words", "marks_per_word", "sentence_ends",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    f = TextFacts(data, offsets)
    size, words = np.diff(offsets).astype(float), f.n_words.astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    share = lambda table: f.count(table) * per_byte
    of_words = lambda flags: _sums(flags, f.first) * per_word
    last, length = data[f.end - 1], f.end - f.start
    upper_in = textops.table_counts(UPPER, data, f.start, f.end)
    follows = np.zeros(len(f.hashes), bool)
    follows[1:] = (f.hashes[1:] == f.hashes[:-1]) & (f.word_row[1:] == f.word_row[:-1])
    n_lines, dup = f.lines()
    marks = share(PUNCTUATION)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(f.count(textops.NOT_SPACE) * per_word), share(UPPER), share(DIGIT), marks, share(SYMBOLS), share(WIDE), share(~textops.NOT_SPACE), np.log1p(words / np.maximum(n_lines, 1)),
        dup / np.maximum(n_lines, 1), f.repeat_words() * per_word, _distinct(f.hashes, f.word_row, f.n) * per_word if len(f.hashes) else words, of_words(follows), of_words((upper_in >= 2) & (2 * upper_in >= length)), of_words(SYMBOLS[last]), of_words(length <= 2), of_words(length >= 20), np.log1p(marks * size * per_word), of_words(SENTENCE_END[last]),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def over_batch(column: pa.Array, measure) -> list:
    """``measure(data, offsets)`` of each piece of a batch of texts, in row order."""
    data, offsets = textops.text_bytes(column)
    return [measure(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in textops.pieces(offsets)]
