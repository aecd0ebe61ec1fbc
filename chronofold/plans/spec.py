"""What a split is asked to be: checked once, when it is made."""

from __future__ import annotations

import datetime
import numbers
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class SplitSpec:
    """Parameters of a temporal split. All sizes count rows of an entity (periods), never calendar time.

    mode: "oos" (test follows train, after a gap) or "is" (test is part of train).
    anchors: where tests start: times, (entity, time) pairs, or positions; None or empty for the default folds.
    missing: what to do where an entity has no test row in a fold: "raise", or "skip" it there.
    time_order: how the default folds of a panel line up its distinct times: "chronological", or "first_seen" (as they first occur when rows are
    sorted by entity, then time, so that the times that only later entities have come last).
    """

    mode: str = "oos"
    n_splits: int = 5
    test_size: int | None = None
    gap: int = 0
    max_train_size: int | None = None
    anchors: tuple[Any, ...] | None = None
    missing: str = "raise"
    time_order: str = "chronological"

    def __post_init__(self) -> None:
        if self.mode not in ("oos", "is"):
            raise ValueError(f"mode must be 'oos' or 'is', not {self.mode!r}")
        if isinstance(self.n_splits, bool) or not isinstance(self.n_splits, numbers.Integral):
            raise ValueError("The number of folds must be of Integral type")
        if self.n_splits <= 1:
            raise ValueError(f"k-fold cross-validation requires at least one train/test split: n_splits={self.n_splits}")
        if self.test_size is not None and self.test_size < 1:
            raise ValueError(f"test_size must be at least 1, not {self.test_size}")
        if self.gap < 0:
            raise ValueError(f"gap must not be negative: {self.gap}")
        if self.mode == "is" and self.gap:
            raise ValueError("an in-sample split has no gap")
        if self.max_train_size is not None and self.max_train_size < 0:
            raise ValueError(f"max_train_size must not be negative: {self.max_train_size}")
        if self.missing not in ("raise", "skip"):
            raise ValueError(f"missing must be 'raise' or 'skip', not {self.missing!r}")
        if self.time_order not in ("chronological", "first_seen"):
            raise ValueError(f"time_order must be 'chronological' or 'first_seen', not {self.time_order!r}")
        object.__setattr__(self, "anchors", normal_anchors(self.anchors))

    @property
    def anchor_kind(self) -> str | None:
        """"position", "pair" or "time", by the first anchor; None without any."""
        if not self.anchors:
            return None
        first = self.anchors[0]
        if isinstance(first, numbers.Integral):
            return "position"
        return "pair" if isinstance(first, tuple) else "time"


def normal_anchors(anchors: Any) -> tuple[Any, ...] | None:
    """A tuple of plain values from a scalar, a list, or any array or index of dates."""
    if anchors is None:
        return None
    if isinstance(anchors, (str, tuple, numbers.Number, datetime.date)) or not isinstance(anchors, Iterable):
        anchors = [anchors]
    return tuple(_plain(a) for a in anchors)


def _plain(value: Any) -> Any:
    if isinstance(value, tuple):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime()
    if type(value).__module__ == "numpy":
        return _plain(value.astype("datetime64[us]").item() if value.dtype.kind == "M" else value.item())
    return value
