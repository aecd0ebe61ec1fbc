"""Chat formatting with a grammar round trip.

Each turn is rendered as ``<open>role<sep>text<close>``. A deterministic parser reads the rendered turn back; where it does
not recover the source (the text holds a control string, or something that looks like an escaped one), the text is
escaped again until it does. Escaping puts one mark after the first character of every control string, escaped ones
included, and unescaping takes one mark away, so it is reversible for every text; and since no control string is left
inside a text, the rendered turns of a conversation can be joined and parsed as one string. The loss mask, the spans of the
trained roles' texts, is carried along with the rendered blocks.

Defined cases: a null text or role is empty; a text of any length is one turn, in memory in proportion to it; turns are ordered by turn, then role, then text (nulls first), so ties and
repeated rows have one order; rows with a null conv_id form one conversation with that id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.scratch import Scratch


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn and the strings that must not occur in a text as they stand."""

    open: str = "<|im_start|>"
    sep: str = "\n"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    mark: str = "\\"
    trained_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if self.open not in self.controls or self.close.rstrip("\n") not in self.controls:
            raise ValueError("the marks of a turn must be control strings")
        for a in self.controls:
            if len(a) < 2 or self.mark in a or "\n" in a:
                raise ValueError(f"not usable as a control string: {a!r}")
            for b in self.controls:
                if (a != b and b in a) or any(a.endswith(b[:i]) for i in range(1, len(b))):
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")

    @cached_property
    def _quoted(self) -> re.Pattern[str]:
        m = re.escape(self.mark)
        return re.compile("|".join(f"({re.escape(c[0])})({m}*)({re.escape(c[1:])})" for c in self.controls))

    @cached_property
    def _parts(self) -> re.Pattern[str]:
        return re.compile("|".join(re.escape(c) for c in self.controls))

    def _each(self, text: str, change) -> str:
        def put(found: re.Match[str]) -> str:
            first, marks, rest = (x for x in found.groups() if x is not None)
            return first + change(marks) + rest

        return self._quoted.sub(put, text)

    def escape(self, text: str) -> str:
        return self._each(text, lambda marks: marks + self.mark)

    def unescape(self, text: str) -> str:
        return self._each(text, lambda marks: marks[len(self.mark) :])

    def render(self, role: str, body: str) -> str:
        """``body``: the text, escaped as far as needed."""
        return f"{self.open}{_role_out(role)}{self.sep}{body}{self.close}"

    def parse(self, rendered: str) -> list[tuple[str, str, int, int]] | None:
        """Role, text, and the span of the still escaped text, of each turn; None if the string isn't a run of turns."""
        turns, at = [], 0
        while at < len(rendered):
            if not rendered.startswith(self.open, at):
                return None
            sep = rendered.find(self.sep, at + len(self.open))
            head = rendered[at + len(self.open) : sep] if sep >= 0 else ""
            if sep < 0 or self._parts.search(head):
                return None
            lo = sep + len(self.sep)
            mark = self._parts.search(rendered, lo)
            if mark is None or not rendered.startswith(self.close, mark.start()):
                return None
            turns.append((_role_in(head), self.unescape(rendered[lo : mark.start()]), lo, mark.start()))
            at = mark.start() + len(self.close)
        return turns

    def format_turn(self, role: str, text: str, rounds: int = 8) -> tuple[str, int, int]:
        """The rendered turn and the span of its text, escaped until parsing it gives the source again."""
        body = text
        for _ in range(rounds):
            rendered = self.render(role, body)
            back = self.parse(rendered)
            if back is not None and len(back) == 1 and back[0][:2] == (role, text):
                return rendered, back[0][2], back[0][3]
            body = self.escape(body)
        raise ValueError("the template can't render this turn")


def _role_out(role: str) -> str:
    """Roles are short names; what could end one is written as %XX of its UTF-8 bytes."""
    return re.sub(r"[^\w .-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), role)


def _role_in(head: str) -> str:
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), head)


ORDER = ("conv_id", "turn", "role", "text")


def _ordered(turns: DataFrame) -> DataFrame:
    """Range-partitioned by conversation *and* turn, so a conversation that holds most of the rows is spread over many tasks."""
    return turns.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def format_turns(turns: DataFrame, template: ChatTemplate = ChatTemplate(), ordered: bool = False) -> DataFrame:
    """conv_id, turn, role, text -> those of each row with ``rendered`` and the span [text_start, text_end) in it that holds the text (``trained``: under the loss mask).

    ``ordered``: the turns are brought into order before they are formatted, for ``conversation_blocks``.
    """
    src = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    src = _ordered(src) if ordered else src

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            role, text = b.column("role").to_pylist(), b.column("text").to_pylist()
            out = [template.format_turn(r, t) for r, t in zip(role, text, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([r in template.trained_roles for r in role], pa.bool_())],
                names=["conv_id", "turn", "role", "text", "rendered", "text_start", "text_end", "trained"],
            )

    return src.mapInArrow(run, "conv_id long, turn long, role string, text string, rendered string, text_start long, text_end long, trained boolean")


def conversation_blocks(formatted: DataFrame, block_chars: int = 1 << 18, ordered: bool = False) -> DataFrame:
    """The rendered conversations as ordered blocks of whole turns: conv_id, part, block, rendered, mask (spans of the block under the loss mask).

    A conversation's blocks, read by (part, block), are its text. ``ordered``: ``format_turns`` did it, so the rows are not shuffled again. Else they are
    saved first: the bounds of ranges are sampled, which would format all turns a second time.
    """
    rows = formatted.select(*ORDER, "rendered", "text_start", "text_end", "trained")
    ranged = rows if ordered else _ordered(Scratch(formatted.sparkSession).save(rows, "formatted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[str] = []
        spans: list[dict] = []
        conv, block, size, began = None, 0, 0, False
        done: list[tuple] = []

        def close() -> None:
            nonlocal block, size
            if held:
                done.append((conv, part, block, "".join(held), list(spans)))
                held.clear()
                spans.clear()
                block, size = block + 1, 0

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("conv_id", "rendered", "text_start", "text_end", "trained"))
            for c, text, lo, hi, trained in zip(*columns, strict=True):
                if not began or c != conv:
                    close()
                    conv, began = c, True
                if trained:
                    spans.append({"start": size + lo, "end": size + hi})
                held.append(text)
                size += len(text)
                if size >= block_chars:
                    close()
            if done:
                yield _rows(done)
                done.clear()
        close()
        if done:
            yield _rows(done)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), span]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "block", "rendered", "mask"])

    return ranged.mapInArrow(run, "conv_id long, part int, block int, rendered string, mask array<struct<start: long, end: long>>")


def read_back(blocks: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Parses the blocks of each conversation in order and digests what comes back, a block at a time.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each parsed turn), loss_chars and loss_sha256 (what stands under the
    mask, unescaped), formatted_chars. A hash is a chain, so the blocks of one conversation pass through one task, streamed.
    """
    near = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row() -> pa.RecordBatch:
            n, all_sha, chars, loss_sha, size = state
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n]), pa.array([all_sha.hexdigest()]), pa.array([chars]), pa.array([loss_sha.hexdigest()]), pa.array([size])], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for c, text, mask in zip(*(b.column(x).to_pylist() for x in ("conv_id", "rendered", "mask")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        yield row()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = template.parse(text)
                if turns is None:
                    raise ValueError(f"conversation {c} does not follow the template's grammar")
                state[4] += len(text)
                for role, said, _, _ in turns:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    learned = template.unescape(text[span["start"] : span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
        if state is not None:
            yield row()

    return near.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
