"""Least squares with any number of regressors for every fold, and entity, at once.

Moments of the regressors and the target come from ``prefix.fold_sums``, so a fold's train is never gathered or copied; what is solved
is one small system a fold and entity, many of them side by side in a task. Systems are solved by Cholesky with limited pivoting: regressors are taken
in the order given, and one that those before it explain (what is left of its variance is ``TOLERANCE`` of it or less) stays out, with a null coefficient.
A constant regressor is such a one. With no complete train row all coefficients and the intercept are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.prefix import centred, fold_sums
from chronofold.operators.keys import Source
from chronofold.operators.splitters import TemporalSplit

TOLERANCE = 1e-9


def solve(cross: np.ndarray, with_y: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Coefficients of many systems: cross (m, p, p) and with_y (m, p), centred sums of products -> (m, p), NaN where a regressor stays out."""
    m, p = with_y.shape
    lower, used = np.zeros((m, p, p)), np.zeros((m, p), bool)
    for j in range(p):
        left = cross[:, j, j] - (lower[:, j, :j] ** 2).sum(axis=1)
        used[:, j] = left > tolerance * np.abs(cross[:, j, j])
        root = np.sqrt(np.where(used[:, j], left, 1.0))
        lower[:, j, j] = np.where(used[:, j], root, 1.0)
        for i in range(j + 1, p):
            lower[:, i, j] = np.where(used[:, j], (cross[:, i, j] - (lower[:, i, :j] * lower[:, j, :j]).sum(axis=1)) / root, 0.0)
    out = np.zeros((m, p))
    for j in range(p):  # forward, then back
        out[:, j] = np.where(used[:, j], (with_y[:, j] - (lower[:, j, :j] * out[:, :j]).sum(axis=1)) / lower[:, j, j], 0.0)
    for j in reversed(range(p)):
        out[:, j] = np.where(used[:, j], (out[:, j] - (lower[:, j + 1 :, j] * out[:, j + 1 :]).sum(axis=1)) / lower[:, j, j], 0.0)
    return np.where(used, out, np.nan)


def fold_regressions(splitter: TemporalSplit, source: Source, y: str, xs: Sequence[str]) -> DataFrame:
    """fold_id, [entity], n (complete train rows), intercept, coefficients (in the order of ``xs``) of y on xs over the fold's train rows of the entity. Rows with a null among them are left out."""
    keys, columns, p = source.keys, [*xs, y], len(xs)
    rows = centred(source, columns)
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    of = lambda c: F.when(complete, F.col(f"_c_{c}"))
    measures = {"m": F.when(complete, F.lit(1))} | {f"s{i}": of(c) for i, c in enumerate(columns)}
    measures |= {f"s{i}_{j}": of(columns[i]) * of(columns[j]) for i in range(p) for j in range(i, p + 1)}
    sums = fold_sums(splitter, source, measures, rows=rows)
    entity = [keys.entity] if keys.entity else []
    if entity:
        means = rows.groupBy(keys.entity).agg(*(F.first(f"_m_{c}").alias(f"mean{i}") for i, c in enumerate(columns)))
        sums = sums.join(means, keys.entity)
    else:
        sums = sums.withColumns({f"mean{i}": v for i, v in enumerate(F.lit(x) for x in rows.select(*(f"_m_{c}" for c in columns)).first())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of = lambda c: b.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            n, s = of("m"), np.stack([of(f"s{i}") for i in range(p + 1)], axis=1)
            products = np.zeros((b.num_rows, p + 1, p + 1))
            for i in range(p):
                for j in range(i, p + 1):
                    products[:, i, j] = products[:, j, i] = of(f"s{i}_{j}") - s[:, i] * s[:, j] / np.maximum(n, 1)
            found = solve(products[:, :p, :p], products[:, :p, p])
            found[n < 1] = np.nan
            means = np.stack([of(f"mean{i}") for i in range(p + 1)], axis=1) + s / np.maximum(n, 1)[:, None]
            intercept = means[:, p] - (np.nan_to_num(found) * means[:, :p]).sum(axis=1) if p else means[:, p]
            plain = pa.array(found.ravel(), from_pandas=True)  # NaN: null
            lists = pa.ListArray.from_arrays(np.arange(0, p * b.num_rows + 1, p, dtype=np.int32) if p else np.zeros(b.num_rows + 1, np.int32), plain)
            held = b.select(["fold_id", *entity]).columns
            yield pa.RecordBatch.from_arrays([*held, pa.array(n.astype(np.int64)), pa.array(np.where(n < 1, np.nan, intercept), from_pandas=True), lists], names=["fold_id", *entity, "n", "intercept", "coefficients"])

    kinds = "".join(f"`{e}` {source.ranks.schema[e].dataType.simpleString()}, " for e in entity)
    wanted = ["fold_id", *entity, "m", *(c for c in sums.columns if c.startswith(("s", "mean")) and c not in entity)]
    return sums.select(*wanted).mapInArrow(run, f"fold_id int, {kinds}n long, intercept double, coefficients array<double>")


def regression_model(splitter: TemporalSplit, source: Source, y: str, xs: Sequence[str]) -> DataFrame:
    """The test rows of all folds, with all columns and ``prediction`` of the regression over the fold's train rows of the entity; null where a regressor is null or nothing was fitted."""
    keys = source.keys
    group = ["fold_id", *([keys.entity] if keys.entity else [])]
    lines = fold_regressions(splitter, source, y, xs).select(*group, F.col("intercept").alias("_intercept"), F.col("coefficients").alias("_coefficients"))
    fitted = F.col("_intercept")
    for i, x in enumerate(xs):
        b = F.get("_coefficients", F.lit(i))
        fitted = fitted + F.when(b.isNull(), F.when(F.col(x).isNotNull(), F.lit(0.0))).otherwise(b * F.col(x))
    test = splitter.assign_rows(source, role="test").drop("role")
    return test.join(lines, group, "left").withColumn("prediction", fitted).drop("_intercept", "_coefficients")
