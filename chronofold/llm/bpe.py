"""BPE encoding by speculation and verification, and decoding.

A text is cut into words as the tokenizer's file says. For each distinct word greedy longest match over a double-array trie
proposes tokens, all words of a batch side by side. A proposal is what merging would give if and only if no two neighbours of it
would ever merge across the cut between them, and that is tested on arrays for every adjacent pair: the last symbols of the left
token and the first symbols of the right one are followed back in the order in which merges made them, and a cut is crossed where
a pair of symbols that exist at the same time has a merge that comes before either of them merges on its own side. Only words
with a crossed cut are merged exactly, by rank.

This needs a token to have one merge, later than those of its parts, which is checked when a file is loaded; tokens that merging
never makes of their own bytes are not proposed. There is no shuffle: each text is encoded where it is read, and a worker
remembers its most recent words.

Defined cases: a null or empty text has no ids, nor has one of white space; a text of any length is encoded whole, in pieces
of about ``textops.pieces``, and a word of any length too (its exact merging takes about 300 bytes a byte); the string of an added
token has that token's id; a character that this Python's tables don't know yet goes through the library's own tables; repeated
rows are encoded alike; a null doc_id is kept as it is; invalid ids raise an error; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chronofold.llm import textops
from chronofold.llm.unigram import DoubleArrayTrie

#: Words that a worker remembers, and how many characters they may have.
CACHE_WORDS = 600_000
CACHE_CHARS = 48
#: Words solved together, of about equal lengths, and bytes from which a word is solved by itself.
SOLVED_WORDS = 4096
LONG_WORD = 256
#: Bytes of text in a batch of results.
RESULT_BYTES = 1 << 20
#: Stands for the end of a word; no UTF-8 text holds it.
END = 0xFF
NEVER = np.iinfo(np.int64).max

# The steps of the tokenizer's file that ``WordCutter`` and ``Merges`` carry out.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
    "decoder": None,
}
_ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter by which such files write each byte: itself if it is printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordCutter:
    """Texts to words: normalised, in lower case, split by the file's pattern. Added tokens stand between the words as their ids."""

    def __init__(self, path: str, added: dict[str, int]) -> None:
        import regex

        self.path, self.added, self._library = path, added, None
        self._added = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self._words, self._ascii = regex.compile(WORDS), re.compile(_ASCII_WORDS)
        self._known: set[str] = set()
        self._bytes = {letter: b for b, letter in enumerate(_byte_letters())}

    def __call__(self, text: str) -> list[str | int]:
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._added.finditer(text):
            out += [*self._plain(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii.findall(text.lower())
        new = set(text) - self._known
        if any(unicodedata.category(c) == "Cn" for c in new):
            return self._by_library(text)
        self._known |= new
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return self._words.findall(text.lower())

    def _by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self._bytes.__getitem__, w)).decode() for w, _ in words]


class Merges:
    """The tokens of a file and how merging makes them: two parts each, and the rank of their merge (``made``; -1 for a byte)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        kinds = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
        if any(file[k] != v for k, v in STEPS.items()) or any(model[k] != v for k, v in kinds.items()):
            raise ValueError(f"{path} isn't a file of lower-case words with word ends, cut by {WORDS}")
        self.path = path
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names: list[str | None] = [None] * (1 + max([*model["vocab"].values(), *self.added.values()]))
        for name, i in [*model["vocab"].items(), *self.added.items()]:
            self.names[i] = name
        n = len(self.names)
        self.left, self.right, self.made = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for rank, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            t = model["vocab"][self.names[a] + self.names[b]]
            if self.made[t] >= 0 or max(self.made[a], self.made[b]) >= rank:
                raise ValueError(f"{self.names[t]!r} has two merges, or one before its parts'")
            self.left[t], self.right[t], self.made[t] = a, b, rank
        made = np.flatnonzero(self.made >= 0)
        keys = self.left[made] * n + self.right[made]
        order = np.argsort(keys)
        self.keys, self.tokens, self.of_rank = keys[order], made[order], made[np.argsort(self.made[made])]
        of_letter = {letter: bytes([b]) for b, letter in enumerate(_byte_letters())}
        raw = lambda name: b"".join(map(of_letter.__getitem__, name.removesuffix("</w>"))) + bytes([END] * name.endswith("</w>"))
        self.raw = {i: raw(name) for name, i in model["vocab"].items()}
        inner, last = {r[0]: i for i, r in self.raw.items() if len(r) == 1}, {r[0]: i for i, r in self.raw.items() if len(r) == 2 and r[1] == END}
        if len(inner) < 256 or len(last) < 256:
            raise ValueError("a byte has no token")
        self.inner, self.last = (np.array([x[b] for b in range(256)], np.int64) for x in (inner, last))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges, or NEVER."""
        keys = a * len(self.names) + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[self.tokens[at]], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge of rank below ``before`` crosses the cut between tokens a and b that stand side by side.

        Time runs back: of the two symbols at the cut the younger is undone (of equal ones the right, since merging goes from the
        left), and its part at the cut lives until its rank. A crossing merge comes before the left symbol's own, and not after
        the right one's: at equal ranks the leftmost pair goes first.
        """
        fits = np.ones(len(a), bool)
        who, a, b = np.arange(len(a)), a.copy(), b.copy()
        a_until = np.full(len(a), before, np.int64)
        b_until = a_until.copy()
        while len(who):
            rank = self.ranks(a, b)
            crossed = (rank < a_until) & (rank <= b_until)
            fits[who[crossed]] = False
            undo_b = self.made[b] >= self.made[a]
            go = ~crossed & (np.maximum(self.made[a], self.made[b]) >= 0)
            b_until, b, a_until, a = np.where(undo_b, self.made[b], b_until), np.where(undo_b, self.left[b], b), np.where(undo_b, a_until, self.made[a]), np.where(undo_b, a, self.right[a])
            who, a, b, a_until, b_until = who[go], a[go], b[go], a_until[go], b_until[go]
        return fits

    def reachable(self) -> np.ndarray:
        """Whether merging the bytes of each token gives that token."""
        good = np.zeros(len(self.names), bool)
        good[self.inner] = good[self.last] = True
        made = np.flatnonzero(self.made >= 0)
        fits = np.zeros(len(self.names), bool)
        fits[made] = self.compatible(self.left[made], self.right[made], self.made[made])
        for t in made[np.argsort(self.made[made])].tolist():  # parts first
            good[t] = fits[t] and good[self.left[t]] and good[self.right[t]]
        return good


class BpeModel:
    """Encodes words. ``failed`` counts those whose proposal didn't hold, of ``solved``."""

    def __init__(self, path: str | None = None) -> None:
        self.merges = Merges(path or default_path())
        good = self.merges.reachable()
        self.trie = DoubleArrayTrie([(r, i) for i, r in self.merges.raw.items() if good[i]])
        self.solved = self.failed = 0
        self._pairs: dict[int, tuple[int, int]] | None = None

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the longest matches of each word, in order. A word ends with END, and no token stops just before it."""
        words, tokens, turn = [], [], []
        who, at = np.arange(len(start)), start.copy()
        while len(who):
            token, at = self._longest(data, at, end[who])
            words.append(who)
            tokens.append(token)
            turn.append(np.full(len(who), len(turn)))
            go = at < end[who]
            who, at = who[go], at[go]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token, turns = (np.concatenate(x) for x in (words, tokens, turn))
        order = np.lexsort((turns, word))
        return word[order], token[order]

    def _longest(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at each place and where it stops."""
        token, stop = np.full(len(start), -1, np.int64), start.copy()
        who, state, at = np.arange(len(start)), np.zeros(len(start), np.int64), start.copy()
        while len(who):
            to = self.trie.base[state] + data[at].astype(np.int64) + 1
            go = self.trie.check[to] == state
            who, state, at = who[go], to[go], at[go] + 1
            piece = self.trie.piece[state]
            done = (piece >= 0) & (at != end[who] - 1)
            token[who[done]], stop[who[done]] = piece[done], at[done]
            go = at < end[who]
            who, state, at = who[go], state[go], at[go]
        return token, stop

    def solve(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit values."""
        out: list[bytes] = [b""] * len(words)
        order = sorted((i for i, w in enumerate(words) if len(w) < LONG_WORD), key=lambda i: len(words[i]))
        for lo in range(0, len(order), SOLVED_WORDS):
            some = order[lo : lo + SOLVED_WORDS]
            for i, ids in zip(some, self._solve_together([words[i] for i in some]), strict=True):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) >= LONG_WORD:
                out[i] = self._solve_long(w)
        return out

    def _solve_together(self, words: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(w + b"\xff" for w in words), np.uint8)
        size = np.array([len(w) + 1 for w in words], np.int64)
        end = np.cumsum(size)
        word, token = self.propose(data, end - size, end)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, at = np.unique(token[inside] * len(self.merges.names) + token[inside + 1], return_inverse=True)
        fits = self.merges.compatible(pairs // len(self.merges.names), pairs % len(self.merges.names))[at]
        wrong = np.zeros(len(words), bool)
        wrong[word[inside[~fits]]] = True
        self.solved, self.failed = self.solved + len(words), self.failed + int(wrong.sum())
        out = _by_word(token, np.bincount(word, minlength=len(words)))
        again = np.flatnonzero(wrong).tolist()
        for i, ids in zip(again, self.merge_together([words[i] for i in again]), strict=True):
            out[i] = ids
        return out

    def merge_together(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of words of about equal lengths side by side: in each round every word merges its pair of the least rank, the leftmost of equal ones."""
        if not words:
            return []
        m, size = self.merges, np.array([len(w) for w in words], np.int64)
        data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size)
        width = np.arange(size.max())
        symbols = np.full((len(words), len(width)), -1, np.int64)
        inside = width[None, :] < size[:, None]
        symbols[inside] = m.inner[data]
        symbols[np.arange(len(words)), size - 1] = m.last[data[end - 1]]
        ranks = np.full((len(words), len(width)), NEVER)  # of the pair that begins at each symbol
        pairs = inside[:, 1:]
        ranks[:, :-1][pairs] = m.ranks(symbols[:, :-1][pairs], symbols[:, 1:][pairs])
        live, left = np.arange(len(words)), size.copy()
        while len(live):
            at = ranks[live].argmin(axis=1)
            rank = ranks[live, at]
            live, at, rank = live[rank < NEVER], at[rank < NEVER], rank[rank < NEVER]
            if not len(live):
                break
            from_ = np.minimum(width[None, :] + (width[None, :] > at[:, None]), len(width) - 1)
            moved, moved_ranks = np.take_along_axis(symbols[live], from_, axis=1), np.take_along_axis(ranks[live], from_, axis=1)
            row = np.arange(len(live))
            moved[row, at] = m.of_rank[rank]
            moved[:, -1], moved_ranks[:, -1] = -1, NEVER
            left[live] -= 1
            for first, some in ((at - 1, at > 0), (at, at + 1 < left[live])):
                moved_ranks[row[some], first[some]] = m.ranks(moved[row[some], first[some]], moved[row[some], first[some] + 1])
            moved_ranks[row, left[live] - 1] = NEVER
            symbols[live], ranks[live] = moved, moved_ranks
        return _by_word(symbols[width[None, :] < left[:, None]], left)

    def _solve_long(self, word: bytes) -> bytes:
        """As above; the longest match of every place first, a block of places at a time, since the matches of one word follow each other."""
        data = np.frombuffer(word + b"\xff", np.uint8)
        tokens, stops = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        for lo in range(0, len(data) - 1, 1 << 16):
            at = np.arange(lo, min(lo + (1 << 16), len(data) - 1))
            tokens[at], stops[at] = self._longest(data, at, np.full(len(at), len(data)))
        taken, at, following = [], 0, stops.tolist()
        while at < len(data):
            taken.append(at)
            at = following[at]
        token = tokens[taken]
        fits = self.merges.compatible(token[:-1], token[1:]).all()
        self.solved, self.failed = self.solved + 1, self.failed + (not fits)
        return token.astype("<u4").tobytes() if fits else self.merge(word)

    def merge(self, word: bytes) -> bytes:
        """The ids by exact merging: the pair of the least rank first, of equal ones the leftmost."""
        if self._pairs is None:
            m = self.merges
            self._pairs = dict(zip(m.keys.tolist(), zip(m.made[m.tokens].tolist(), m.tokens.tolist(), strict=True), strict=True))
        n = len(self.merges.names)
        symbols = [*self.merges.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.merges.last[word[-1]])]
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rank = lambda i: self._pairs.get(symbols[i] * n + symbols[after[i]]) if after[i] < len(symbols) else None
        todo = [(r[0], i, r[1]) for i in range(len(symbols) - 1) if (r := rank(i))]
        heapify(todo)
        while todo:
            _, i, token = heappop(todo)
            if symbols[i] < 0 or (r := rank(i)) is None or r[1] != token:
                continue
            j = after[i]
            symbols[i], symbols[j], after[i] = token, -1, after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)):
                    heappush(todo, (r[0], k, r[1]))
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()


def _by_word(tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw, ends = tokens.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(4 * counts))).tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Encoder:
    """Texts to ids with the words that this worker has met lately."""

    def __init__(self, model: BpeModel) -> None:
        self.model, self.cut = model, WordCutter(model.merges.path, model.merges.added)
        self._known: dict[str | int, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit values."""
        words = [self.cut(t) if t else [] for t in texts]
        new = set().union(*words) - self._known.keys()
        if len(self._known) + len(new) > CACHE_WORDS:
            self._known, new = {}, set().union(*words)
        fresh = [w for w in new if isinstance(w, str)]
        found = dict(zip(fresh, self.model.solve([w.encode() for w in fresh]), strict=True))
        found |= {w: np.array([w], "<u4").tobytes() for w in new if isinstance(w, int)}
        self._known |= found
        out = [b"".join(map(self._known.__getitem__, ws)) for ws in words]
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del self._known[w]
        return out


def decoded(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """The texts of lists of ids: the tokens' names with a space between them, as a file without a decoder says."""
    taken = names.take(ids.flatten())
    if taken.null_count:
        raise ValueError("an id isn't in the vocabulary")
    ends = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(ends, taken), " ")


def encode_documents(docs: DataFrame, model: BpeModel | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""
    return _run(docs, model or BpeModel(), False)


def decode_documents(encoded: DataFrame, model: BpeModel | None = None) -> DataFrame:
    """doc_id, text of rows of doc_id, ids; null ids are none."""
    names = (model or BpeModel()).merges.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names)
        for b in textops.long_rows(batches):
            ids = pc.fill_null(b.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), decoded(ids, known)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: BpeModel | None = None) -> DataFrame:
    """doc_id, ids, and the text that decoding these ids gives, made by the same worker."""
    return _run(docs, model or BpeModel(), True)


def _run(docs: DataFrame, model: BpeModel, back: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = Encoder(model), pa.array(model.merges.names)
        for b in textops.long_rows(batches):
            _, offsets = textops.text_bytes(b.column("text"))
            for lo, hi in textops.pieces(offsets, RESULT_BYTES):
                raw = encoder.encode(b.column("text").slice(lo, hi - lo).to_pylist())
                ends = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raw), "<i4")))
                columns = {"doc_id": b.column("doc_id").slice(lo, hi - lo), "ids": ids}
                if back:
                    columns["text"] = decoded(ids, known)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * back)
