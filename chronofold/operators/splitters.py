"""Splitters of time series and panels into train and test, out of sample and in sample.

``assign`` gives all folds as one relation, ``bounds`` the folds as ranges, ``split`` the folds one after another as pairs of
DataFrames with all columns. Rows are identified by key, so neither the order nor the partitioning of the input matters.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators import assign as assigning
from chronofold.operators.bounds import fold_bounds
from chronofold.operators.keys import SERIES_IN_ONE_TASK, Keys, Source, check_keys, ranked, ranked_at_once, same_keys, warn_if_unsorted
from chronofold.plans.spec import SplitSpec
from chronofold.scratch import Scratch


#: Bytes that Spark expects of a row, at least (files are compressed), for a source to count as small.
ROW_BYTES = 8
#: Rows whose keys Spark may broadcast, if it expects few bytes of them; keys of more are joined by merging.
BROADCAST_KEYS = 500_000


def _prepared(df: DataFrame, keys: Keys, data: bool, hot: bool) -> Source:
    """Checks and ranks the rows, running what made them once.

    A source that Spark expects to have few enough rows for one task is ranked and checked as it is first written. Of another one the keys are written
    first; where they show an entity too large for one task, or with ``hot``, rows are ranked by ranges.
    """
    others = [c for c in df.columns if c not in keys.columns]
    own = df.select(*keys.columns, F.struct(*others).alias("_data")) if data and others else df.select(*keys.columns)
    if not hot and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= ROW_BYTES * SERIES_IN_ONE_TASK:
        return ranked_at_once(own, keys)
    scratch = Scratch(df.sparkSession)
    saved = scratch.save(own, "keys")
    shape = check_keys(saved.select(*keys.columns), keys)
    spread = hot or shape.largest > SERIES_IN_ONE_TASK
    ranks = ranked(saved, keys, spread=spread, **({"data": True} if data else {}))
    return Source(keys, scratch.save(ranks, "ranks") if not spread and (data or shape.rows > SERIES_IN_ONE_TASK) else ranks, shape)


class TemporalSplit:
    """What all splitters share; a subclass says the mode and which keys it takes.

    ``tiebreak``: columns that put rows of equal times in order; then only time and tiebreak together must not repeat in an entity, and an anchor's
    time stands for its first row.
    """

    mode = "oos"

    def __init__(self, n_splits: int = 5, *, test_indices: Any = None, max_train_size: int | None = None, test_size: int | None = None, gap: int = 0, missing: str = "raise", time_order: str = "chronological", tiebreak: Sequence[str] = ()) -> None:
        self.spec = SplitSpec(self.mode, n_splits, test_size, gap, max_train_size, test_indices, missing, time_order)
        self.tiebreak = (tiebreak,) if isinstance(tiebreak, str) else tuple(tiebreak)

    def __repr__(self) -> str:
        s = self.spec
        return f"{type(self).__name__}(n_splits={s.n_splits}, test_indices={s.anchors}, max_train_size={s.max_train_size}, test_size={s.test_size}, gap={s.gap})"

    def _keys(self, time: str, entity: str | None) -> Keys:
        return Keys(time, entity, self.tiebreak)

    def source(self, df: DataFrame, time: str, entity: str | None = None, *, y: DataFrame | None = None, ordinal: str | None = None, hot_entities: bool = False, data: bool = True) -> Source:
        """The rows, checked, ranked and saved with all their columns, so that what made ``df`` runs once. The methods below take it in place of ``df``."""
        keys = self._keys(time, entity)
        keys.check(df)
        found = _prepared(df, keys, data, hot_entities)
        if y is not None and not same_keys(found.ranks, y, keys):
            raise ValueError("X and y should have the same indexes")
        if ordinal is not None:
            warn_if_unsorted(df, ordinal, keys)
        return found

    def _taken(self, df: DataFrame | Source, time: str | None, entity: str | None, y: DataFrame | None, ordinal: str | None, hot_entities: bool) -> Source:
        found = df if isinstance(df, Source) else self.source(df, time, entity, y=y, ordinal=ordinal, hot_entities=hot_entities, data=False)
        self._keys(found.keys.time, found.keys.entity)
        if found.keys.entity is not None and self.spec.anchor_kind is None and not found.shape.times:
            found = replace(found, shape=replace(found.shape, times=found.ranks.agg(F.count_distinct(found.keys.time)).first()[0]))
        return found

    def bounds(self, df: DataFrame | Source, time: str | None = None, entity: str | None = None, *, y: DataFrame | None = None, ordinal: str | None = None, hot_entities: bool = False) -> DataFrame:
        """fold_id, [entity], test_lo, test_hi, points, train_lo, train_hi: positions within the entity."""
        found = self._taken(df, time, entity, y, ordinal, hot_entities)
        return fold_bounds(found.ranks, found.keys, self.spec, found.shape)[0]

    def assign(self, df: DataFrame | Source, time: str | None = None, entity: str | None = None, *, y: DataFrame | None = None, ordinal: str | None = None, hot_entities: bool = False, role: str | None = None) -> DataFrame:
        """fold_id, role, [entity], time, pos of all folds. ``hot_entities``: rank by ranges in any case, not only where an entity is too large for one task. ``role``: 'train' or 'test' rows only. Errors are raised here, not when the result is computed."""
        found = self._taken(df, time, entity, y, ordinal, hot_entities)
        return self._assigned(found, found.ranks.select(*found.keys.columns, "pos", "size"), role)

    def assign_rows(self, df: DataFrame | Source, time: str | None = None, entity: str | None = None, *, hot_entities: bool = False, role: str | None = None) -> DataFrame:
        """fold_id, role and all columns of the rows of all folds, from a saved source: nothing is joined."""
        return self._rows(df, time, entity, hot_entities, role, "fold_id", "role")

    def _rows(self, df: DataFrame | Source, time: str | None, entity: str | None, hot_entities: bool, role: str | None, *names: str) -> DataFrame:
        if not isinstance(df, Source):
            df = self.source(df, time, entity, hot_entities=hot_entities)
        found = self._taken(df, None, None, None, None, False)
        out = self._assigned(found, found.ranks, role).drop("pos").withColumnsRenamed(dict(zip(("fold_id", "role"), names, strict=True)))
        data = out.schema["_data"].dataType.names if "_data" in out.columns else []
        if taken := [c for c in data if c in names]:
            raise ValueError(f"columns need names of their own, not {', '.join(taken)}: rename them")
        return out.select(*names, *found.keys.columns, *(["_data.*"] if data else []))

    def _assigned(self, found: Source, ranks: DataFrame, role: str | None) -> DataFrame:
        bounds, folds = fold_bounds(found.ranks, found.keys, self.spec, found.shape)
        return assigning.assignment(ranks, bounds, found.keys, folds, found.shape, len(self.spec.anchors or ()), role)

    def split(self, df: DataFrame, time: str, entity: str | None = None, *, y: DataFrame | None = None, ordinal: str | None = None, hot_entities: bool = False) -> Iterator[tuple[DataFrame, DataFrame]]:
        """(train, test) of each fold with all columns of ``df``. Checks run at once, folds when they are asked for."""
        found = self._taken(df, time, entity, y, ordinal, hot_entities)
        bounds, folds = fold_bounds(found.ranks, found.keys, self.spec, found.shape)
        return self._folds(df, found, bounds, folds)

    def _folds(self, df: DataFrame, found: Source, bounds: DataFrame, folds: int) -> Iterator[tuple[DataFrame, DataFrame]]:
        """Each side reads only its own times: they are literals of a filter, which a scan can use. Of a series, whose times are unique, nothing else tells a range of rows apart."""
        keys = found.keys
        times = assigning.time_ranges(found.ranks, bounds, keys, folds * found.shape.entities)
        sets = len(self.spec.anchors or ()) > 1 and self.spec.mode == "is"
        if keys.entity is None and not keys.tiebreak:
            slices = {(i, role): df.where(times.get((i, role), F.lit(False))) for i in range(folds) for role in ("train", "test")}
            for i in range(folds):
                test = slices[i, "test"]
                if sets:
                    rows = assigning.assignment(found.ranks, bounds.where(F.col("fold_id") == i), keys, 1, found.shape, len(self.spec.anchors), "test")
                    test = self._side(test, found, rows, "test")
                yield slices[i, "train"], test
            return
        for i in range(folds):
            part = {role: df.where(times.get((i, role), F.lit(False))) for role in ("train", "test")}
            rows = assigning.assignment(found.ranks, bounds.where(F.col("fold_id") == i), found.keys, 1, found.shape, len(self.spec.anchors or ()) if folds == 1 else 0)
            yield self._side(part["train"], found, rows, "train"), self._side(part["test"], found, rows, "test")

    @staticmethod
    def _side(df: DataFrame, found: Source, rows: DataFrame, role: str) -> DataFrame:
        own = rows.where(F.col("role") == role).select(*found.keys.columns).distinct()
        return df.join(own if found.shape.rows <= BROADCAST_KEYS else own.hint("merge"), found.keys.columns, "left_semi")

    def get_n_splits(self, df: DataFrame | Source, time: str | None = None, entity: str | None = None) -> int:
        """The number of folds that ``split`` gives for these data."""
        found = self._taken(df, time, entity, None, None, False)
        return fold_bounds(found.ranks, found.keys, self.spec, found.shape)[1]


class OutOfSampleSplit(TemporalSplit):
    """Train lies before the test, at least ``gap`` rows away: expanding, or rolling with ``max_train_size``. A panel if an entity column is given."""


class InSampleSplit(TemporalSplit):
    """One fold whose train holds the test rows and what precedes them."""

    mode = "is"

    def __init__(self, n_splits: int = 5, *, test_indices: Any = None, max_train_size: int | None = None, test_size: int | None = None, missing: str = "raise", time_order: str = "chronological", tiebreak: Sequence[str] = ()) -> None:
        super().__init__(n_splits, test_indices=test_indices, max_train_size=max_train_size, test_size=test_size, missing=missing, time_order=time_order, tiebreak=tiebreak)


class _SeriesOnly:
    def _keys(self, time: str, entity: str | None) -> Keys:
        if entity is not None:
            warnings.warn("groups are ignored by a time series splitter", stacklevel=4)
        return Keys(time, None, self.tiebreak)


class _PanelOnly:
    def _keys(self, time: str, entity: str | None) -> Keys:
        if entity is None:
            raise ValueError("Panel data requires MultiIndex keys: an entity and a time column")
        return Keys(time, entity, self.tiebreak)


class TSOutOfSampleSplit(_SeriesOnly, OutOfSampleSplit):
    """Out of sample, one series."""


class TSInSampleSplit(_SeriesOnly, InSampleSplit):
    """In sample, one series."""


class PanelOutOfSampleSplit(_PanelOnly, OutOfSampleSplit):
    """Out of sample, a panel: folds at common times, rows counted within each entity."""


class PanelInSampleSplit(_PanelOnly, InSampleSplit):
    """In sample, a panel."""


class _EachEntity(_PanelOnly):
    """Folds by entity: ``split`` gives a pair for each fold and, in its order, each entity that has test rows there."""

    def _folds(self, df: DataFrame, found: Source, bounds: DataFrame, folds: int) -> Iterator[tuple[DataFrame, DataFrame]]:
        entity = found.keys.entity
        for i in range(folds):
            own = bounds.where(F.col("fold_id") == i)
            for row in own.select(entity).orderBy(entity).toLocalIterator():
                one = F.col(entity).eqNullSafe(F.lit(row[0]))
                rows = assigning.assignment(found.ranks.where(one), own.where(one), found.keys, 1, found.shape)
                part = df.where(one)
                yield self._side(part, found, rows, "train"), self._side(part, found, rows, "test")

    def get_n_splits(self, df: DataFrame | Source, time: str | None = None, entity: str | None = None) -> int:
        return self.bounds(df, time, entity).count()

    def each_streamed(self, df: DataFrame, time: str, entity: str, func: Callable[[Iterator[Any], Iterator[Any]], Iterator[Any]], schema: str) -> DataFrame:
        """As ``each`` for entities of any size: ``func(train, test)`` takes two iterators of pandas frames in the order of time, first all of train, then test, and yields frames.

        A task holds one batch of Arrow at a time; what ``func`` keeps of train (a model that learns by batches, sums) is its own. What it leaves of either is skipped.
        """
        rows = self._rows(df, time, entity, False, None, "_fold", "_role")
        columns = df.columns
        order = ["_fold", entity, F.desc("_role"), time, *self.tiebreak]  # train before test
        data = rows.select("_fold", "_role", *columns).repartition("_fold", entity).sortWithinPartitions(*order)

        def run(frames: Iterator[Any]) -> Iterator[Any]:
            parts = _Parts(frames, entity)
            while (key := parts.next_key()) is not None:
                train, test = (parts.of(key, role, columns) for role in ("train", "test"))
                for out in func(train, test):
                    out.insert(0, "fold_id", key[0])
                    out.insert(1, entity, key[1])
                    yield out
                for _ in (*train, *test):
                    pass

        kind = df.schema[entity].dataType.simpleString()
        return data.mapInPandas(run, f"fold_id int, `{entity}` {kind}, {schema}")

    def each(self, df: DataFrame, time: str, entity: str, func: Callable[[Any, Any], Any], schema: str) -> DataFrame:
        """``func(train, test)`` for every fold and entity at once, on the cluster: all columns of ``df`` as pandas frames in the order of time.

        What it returns (a frame as ``schema`` says, without names fold_id and the entity's) becomes one relation with fold_id and the entity in front.
        An entity's rows of a fold must fit a task; aggregates of larger ones are ``functions.models`` over ``assign``.
        """
        data = self._rows(df, time, entity, False, None, "_fold", "_role")
        data = data.select("_fold", "_role", *df.columns)

        def run(key: tuple, frame: Any) -> Any:
            frame = frame.sort_values([time, *self.tiebreak]).reset_index(drop=True)
            test = frame["_role"] == "test"
            out = func(*(frame[side].drop(columns=["_fold", "_role"]).reset_index(drop=True) for side in (~test, test)))
            out.insert(0, "fold_id", key[0])
            out.insert(1, entity, key[1])
            return out

        kind = df.schema[entity].dataType.simpleString()
        return data.groupBy("_fold", entity).applyInPandas(run, f"fold_id int, `{entity}` {kind}, {schema}")


class _Parts:
    """Sorted frames cut where fold, entity or role change."""

    def __init__(self, frames: Iterator[Any], entity: str) -> None:
        self._cut = self._pieces(frames, entity)
        self._ahead = next(self._cut, None)

    @staticmethod
    def _pieces(frames: Iterator[Any], entity: str) -> Iterator[tuple[tuple, str, Any]]:
        for frame in frames:
            if len(frame):
                by = frame[["_fold", entity, "_role"]]
                starts = [0, *(i for i in range(1, len(frame)) if tuple(by.iloc[i]) != tuple(by.iloc[i - 1]))] if len(by.drop_duplicates()) > 1 else [0]
                for lo, hi in zip(starts, [*starts[1:], len(frame)], strict=True):
                    fold, name, role = by.iloc[lo]
                    yield (int(fold), name), role, frame.iloc[lo:hi]

    def next_key(self) -> tuple | None:
        return None if self._ahead is None else self._ahead[0]

    def of(self, key: tuple, role: str, columns: list[str]) -> Iterator[Any]:
        """The frames of a role of a key. Test frames come once those of train have been read or skipped."""
        while self._ahead is not None and self._ahead[0] == key and self._ahead[1] != role and role == "test":
            self._ahead = next(self._cut, None)
        while self._ahead is not None and self._ahead[:2] == (key, role):
            frame, self._ahead = self._ahead[2], next(self._cut, None)
            yield frame[columns].reset_index(drop=True)


class PanelOutOfSampleSplitPerEntity(_EachEntity, OutOfSampleSplit):
    """Out of sample, each entity of a panel by itself."""


class PanelInSampleSplitPerEntity(_EachEntity, InSampleSplit):
    """In sample, each entity of a panel by itself."""
