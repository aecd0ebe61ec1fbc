"""Temporal cross-validation as Spark relations, and corpus preparation in ``chronofold.llm``."""

from chronofold.operators.splitters import (
    InSampleSplit,
    OutOfSampleSplit,
    PanelInSampleSplit,
    PanelInSampleSplitPerEntity,
    PanelOutOfSampleSplit,
    PanelOutOfSampleSplitPerEntity,
    TSInSampleSplit,
    TSOutOfSampleSplit,
)

__all__ = [
    "InSampleSplit",
    "OutOfSampleSplit",
    "PanelInSampleSplit",
    "PanelInSampleSplitPerEntity",
    "PanelOutOfSampleSplit",
    "PanelOutOfSampleSplitPerEntity",
    "TSInSampleSplit",
    "TSOutOfSampleSplit",
]
