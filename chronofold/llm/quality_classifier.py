"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics of a whole text are standardised, mapped to cosine features whose inner products approximate a Gaussian kernel,
and a ridge regression is solved from normal equations that every partition sums for itself. Scores of rows set aside are
binned, and the pool-adjacent-violators rule turns bins into rising probabilities.

Defined cases: a null text is empty and is scored like one; a text of any length is measured whole (a long one in
windows, memory follows its words and lines); repeated rows score alike; of rows that repeat a labelled id the text with the least
hash is learned from, once; a null doc_id is kept as it is; contradicting labels of one document are left out; without
labels of both classes every score is the share of good labels (1/2 without any); an empty table gives no rows; other
columns are ignored (``filter_documents`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm import doc_stats, textops
from chronofold.llm.quality_rules import labelled_documents, labelled_sample
from chronofold.scratch import Scratch

#: Labelled rows that the classifier is fitted on, at most.
MAX_LABELLED = 20_000
FEATURES = 320
#: Width of the Gaussian kernel in standard deviations of the statistics.
WIDTH = 4.0
RIDGE = 1e-3
BINS = 512
#: Rows of either label added to each bin.
SMOOTHING = 0.01
SEED = 7


@dataclass(frozen=True)
class FourierModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def _directions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    d = len(doc_stats.STATISTICS)
    return rng.normal(size=(d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(x: np.ndarray) -> np.ndarray:
    """Cosine features, and a constant one."""
    w, b = _directions()
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -8, 8) @ w + b)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _constant(value: float) -> FourierModel:
    d = len(doc_stats.STATISTICS)
    return FourierModel(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), np.array([0.0]), np.array([value]))


def isotonic(centres: np.ndarray, counts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising means of ``good / counts`` over bins in order, as points to interpolate between. Bins are smoothed before they are pooled, so that no mean is 0 or 1 and all rise."""
    blocks: list[list[float]] = []
    for c, n, g in zip(centres, counts, good, strict=True):
        n, g = n + 2 * SMOOTHING, g + SMOOTHING
        blocks.append([c * n, n, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[0] / b[1] for b in blocks])
    return at, np.array([b[2] / b[1] for b in blocks])


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> FourierModel:
    """Fits on at most ``limit`` labelled documents that aren't held out."""
    rows = labelled_documents(docs, labelled_sample(labels, limit, ~held_out(F.col("doc_id"))))
    d = len(doc_stats.STATISTICS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            stats = np.concatenate(doc_stats.over_batch(b.column("text"), doc_stats.statistics))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("part"), *(pa.array(stats[:, i]) for i in range(d))], names=["y", "part", *doc_stats.STATISTICS])

    scratch = Scratch(docs.sparkSession)
    found = scratch.save(rows.select("y", "part", "text").mapInArrow(measure, "y int, part int, " + ", ".join(f"{c} double" for c in doc_stats.STATISTICS)), "statistics")
    try:
        one = found.agg(F.count("*").alias("n"), F.sum("y").alias("good"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(doc_stats.STATISTICS)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(doc_stats.STATISTICS))).first()
        if not one["n"]:
            return _constant(0.5)
        if one["good"] in (0, one["n"]):
            return _constant(float(one["good"] / one["n"]))
        mean = np.array([one[f"m{i}"] for i in range(d)])
        scale = np.array([one[f"s{i}"] or 0.0 for i in range(d)])
        scale[scale < 1e-9] = 1.0
        fit, aside = found.where("part <> 0"), found.where("part = 0")
        weights = _solve(fit, mean, scale)
        model = FourierModel(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        knots, values = _calibrate(aside, model)
        return FourierModel(mean, scale, weights, knots, values) if len(knots) else model
    finally:
        scratch.drop(found)


def _numbers(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in doc_stats.STATISTICS], axis=1)


def _solve(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Ridge weights from the sums of z z' and z y: a partition adds up its own, and the matrix's rows are summed apart."""
    size = FEATURES + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in textops.long_rows(batches):
            z = fourier((_numbers(b) - mean) / scale)
            total += z.T @ np.concatenate([z, b.column("y").to_numpy()[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("i").to_pylist(), b.column("sums"), strict=True):
                sums[i] = sums.get(i, 0) + x.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "sums"])

    schema = "i int, sums array<double>"
    summed = rows.mapInArrow(partial, schema).repartition(8, "i").mapInArrow(add, schema).collect()  # FEATURES + 1 rows
    total = np.zeros((size, size + 1))
    for r in summed:
        total[r["i"]] = r["sums"]
    penalty = RIDGE * max(1.0, total[-1, size - 1]) / FEATURES * np.eye(size)
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(total[:, :size] + penalty, total[:, size])


def _calibrate(rows: DataFrame, model: FourierModel) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = -0.5, 1.5

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            at = np.clip((model.raw(_numbers(b)) - lo) / (hi - lo) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("y")], names=["bin", "y"])

    bins = rows.mapInArrow(scored, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()  # BINS rows at most
    centres = np.array([lo + (r["bin"] + 0.5) * (hi - lo) / BINS for r in bins])
    return isotonic(centres, np.array([r["n"] for r in bins], float), np.array([r["good"] for r in bins], float))


def score_documents(docs: DataFrame, model: FourierModel) -> DataFrame:
    """doc_id, held_out, score (higher: a good label is likelier) and predicted (1 from a score of 1/2) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            score = model.score(np.concatenate(doc_stats.over_batch(b.column("text"), doc_stats.statistics)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, model: FourierModel) -> DataFrame:
    """The rows predicted good, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            score = model.score(np.concatenate(doc_stats.over_batch(b.column("text"), doc_stats.statistics)))
            yield b.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)
