"""Byte-level BPE ids of whole texts, with a cache of space-separated segments.

The tokenizer's pattern starts a new piece at every space that a non-space follows, so a text may be cut there without
changing its ids. Most segments repeat, and each distinct one is encoded once per worker process. A text that holds the
string of an added token (<|endoftext|>) goes to the tokenizer whole, which gives that token its own id.
"""

from __future__ import annotations

import base64
import json
import re

#: Segments kept by a worker; then it starts anew.
CACHE_SEGMENTS = 400_000
CACHE_CHARS = 48


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Cache(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_SEGMENTS:
                self.clear()
            self[word] = ids
        return ids


class SegmentEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes: those of the tokenizer in the file, called without further special tokens."""

    _open_end = re.compile(r" (?=\s|\Z)")
    _cut = re.compile(r" (?!\s|\Z)")

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json_path, self._plain = json_path, None
        with open(json_path, "rb") as f:
            self._added = [t["content"] for t in json.load(f)["added_tokens"]]
        self._cache = _Cache(self._ids)

    def _ids(self, text: str) -> bytes:
        import numpy as np

        try:
            ids = self._bpe.encode_ordinary(text)
        except BaseException as error:  # the pattern engine panics on endless white space
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self._whole(text)
        return np.asarray(ids, "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self._tokenizer().encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _tokenizer(self):
        if self._plain is None:
            from tokenizers import Tokenizer

            self._plain = Tokenizer.from_file(self._json_path)
        return self._plain

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self._added):
            return self._whole(text)
        parts = self._cut.split(text) if self._open_end.search(text) else text.split(" ")
        first = self._ids(parts[0]) if parts[0] else b""
        return first + b"".join(map(self._cache.__getitem__, parts[1:]))


_ENCODERS: dict[tuple[str, str], SegmentEncoder] = {}


def encoder(paths: tuple[str, str]) -> SegmentEncoder:
    """One encoder a process and pair of files."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = SegmentEncoder(*paths)
    return _ENCODERS[paths]
