"""Quality rules: fixed limits on counts, then a hashed n-gram model with calibrated probabilities.

One logistic regression over relative frequencies of hashed character n-grams, words, word pairs and pairs of word shapes is
fitted on labelled rows (each step sums the gradients of all partitions, until it converges), a part of them is set aside
to calibrate its margins to probabilities, and every document is scored in Arrow batches and held against a fixed threshold.

Defined cases: a null text has no words and fails the base rules; a text without n-grams of a kind gets nothing from that
kind; a text of any length is read whole (a long one in windows whose counts add up: memory follows its words and lines);
repeated rows are judged alike; of rows that repeat a labelled id the text with the least hash is learned from, once; a
null doc_id is kept as it is; without labels of both classes the model's verdict is to keep; an empty table gives
no rows; other columns are ignored (``filter_documents`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronofold.llm import doc_stats, textops
from chronofold.llm.textops import U64
from chronofold.scratch import Scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Calibrated probability of good quality from which a document is kept.
THRESHOLD = 0.5
#: Labelled rows that the model is fitted on, at most.
MAX_LABELLED = 6000
BITS = 14
#: Every so many labelled rows are for calibration only.
CALIBRATION_PART = 5
#: Weight of the squared weights (of standardised features); steps at most, and the relative gain at which they end.
L2 = 0.1
STEPS = 200
TOLERANCE = 1e-4
#: Rows whose vectors stand in a task's memory at a time.
VECTOR_ROWS = 128
CHAR_GRAMS = (3, 5)
SCALE = 30.0
N_KINDS = len(CHAR_GRAMS) + 3


def _slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes >> U64(64 - BITS)).astype(np.int64) + (kind << BITS)


def _shapes(f: doc_stats.TextFacts, lo: int, hi: int) -> np.ndarray:
    """A small number for the look of each of the words lo..hi: case, last and first mark, length, equal to the word before."""
    data, start, end = f.data, f.start[lo:hi], f.end[lo:hi]
    length = end - start
    upper = textops.table_counts(doc_stats.UPPER, data, start, end)
    case = np.where(upper == 0, 0, np.where(upper >= np.maximum(2, length // 2), 2, 1))
    last, head = data[end - 1] if len(end) else data[:0], data[start] if len(start) else data[:0]
    mark = np.where(doc_stats.PUNCTUATION[last], last, 0).astype(np.int64)
    front = doc_stats.PUNCTUATION[head].astype(np.int64)
    again = np.zeros(len(start), np.int64)
    first = 1 if lo == 0 else 0
    before = slice(lo + first - 1, max(lo + first, hi) - 1)
    again[first:] = (f.hashes[lo + first : hi] == f.hashes[before]) & (f.word_row[lo + first : hi] == f.word_row[before])
    return ((((case * 128 + mark) * 2 + front) * 2 + again) * 8 + np.minimum(length // 3, 7)).astype(U64)


def _windows(n: int, k: int) -> Iterator[tuple[int, int]]:
    """Ranges that overlap so that each run of k of n things lies in just one of them; all in one if they are few."""
    if n <= textops.WINDOW + k:
        yield 0, n
        return
    for at in range(0, n - k + 1, textops.WINDOW):
        yield at, min(at + textops.WINDOW + k - 1, n)


def _char_slots(data: np.ndarray, offsets: np.ndarray, kind: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, counts = data.astype(U64), np.maximum(np.diff(offsets) - k + 1, 0)
    hashes = np.zeros(max(0, len(data) - k + 1), U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            hashes |= data[i : i + len(hashes)] << U64(8 * i)
        hashes *= U64(textops.RADIX)
    slots = _slot(hashes ^ (hashes << U64(29)), kind)
    inside = np.ones(len(slots), bool)
    for i in range(1, k):  # n-grams that would reach into the next row
        ends = offsets[1:] - i
        ends = ends[(ends >= 0) & (ends < len(slots))]
        inside[ends] = False
    # a row shorter than k has its bytes dropped by the rule above as well
    return slots[inside], np.concatenate(([0], np.cumsum(counts)))


def features(f: doc_stats.TextFacts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Kind of n-gram, its feature slots of all rows one after another, and where each row's begin (n + 1 bounds). A long text, which is the only row then, gives each kind in several parts."""
    for kind, k in enumerate(CHAR_GRAMS):
        for lo, hi in _windows(len(f.data), k) if f.n == 1 else [(0, len(f.data))]:
            yield kind, *_char_slots(f.data[lo:hi], np.array([0, hi - lo]) if f.n == 1 else f.offsets, kind, k)
    kind = len(CHAR_GRAMS)
    for lo, hi in _windows(len(f.hashes), 2) if f.n == 1 else [(0, len(f.hashes))]:
        first = np.array([0, hi - lo]) if f.n == 1 else f.first
        alone = np.array([0, hi - lo - (hi < len(f.hashes))]) if f.n == 1 else f.first  # a window's last word is the next one's first
        yield kind, _slot(f.hashes[lo : lo + alone[-1]], kind), alone
        at, counts = textops.gram_starts(first, 2)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        yield kind + 1, _slot(textops.gram_hashes(f.hashes[lo:hi], 2)[at], kind + 1), bounds
        yield kind + 2, _slot(textops.gram_hashes(textops.mix(_shapes(f, lo, hi)), 2)[at], kind + 2), bounds


def margins(f: doc_stats.TextFacts, weights: np.ndarray) -> np.ndarray:
    """Weighted relative frequencies, summed over the kinds."""
    total, seen = np.zeros((N_KINDS, f.n)), np.zeros((N_KINDS, f.n), np.int64)
    for kind, slots, bounds in features(f):
        sums = np.zeros(len(slots) + 1)
        np.cumsum(weights[slots], out=sums[1:])
        total[kind] += sums[bounds[1:]] - sums[bounds[:-1]]
        seen[kind] += np.diff(bounds)
    return (SCALE * total / np.maximum(seen, 1)).sum(axis=0)


def sparse_rows(f: doc_stats.TextFacts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature slots and values of each row, for training."""
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    seen = np.zeros((N_KINDS, f.n), np.int64)
    for kind, slots, bounds in features(f):
        seen[kind] += np.diff(bounds)
        for i in range(f.n):
            own, counts = np.unique(slots[bounds[i] : bounds[i + 1]], return_counts=True)
            if (kind, i) in found:
                own, place = np.unique(np.concatenate((found[kind, i][0], own)), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate((found[kind, i][1], counts)), minlength=len(own)).astype(np.int64)
            found[kind, i] = own, counts
    kinds = range(N_KINDS)
    return [(np.concatenate([found[k, i][0] for k in kinds]), np.concatenate([SCALE * found[k, i][1] / max(1, seen[k, i]) for k in kinds])) for i in range(f.n)]


@dataclass(frozen=True)
class QualityModel:
    """Weights of the feature slots, and slope and intercept that turn a margin into a probability."""

    weights: np.ndarray
    slope: float
    intercept: float

    def probability(self, f: doc_stats.TextFacts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins(f, self.weights) + self.intercept, -50, 50)))


KEEP_ALL = QualityModel(np.zeros(N_KINDS << BITS), 0.0, 50.0)


def labelled_sample(labels: DataFrame, limit: int, keep=None) -> DataFrame:
    """At most ``limit`` labelled documents in the order of a hash of their ids: doc_id, y, part (a small number for splits). Documents with contradicting labels are left out."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(keep) if keep is not None else rows
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("other")).where("y = other")
    rows = rows.select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("order"))
    return rows.orderBy("order", "doc_id").limit(limit).select("doc_id", "y", F.pmod("order", F.lit(CALIBRATION_PART)).cast("int").alias("part"))


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with smoothed targets. A step that would raise the loss is halved, since whole steps can swing to and fro where margins lie far from the cut."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    loss = lambda w: float((np.logaddexp(0, x @ w) - target * (x @ w)).sum() + 5e-4 * (w - start) @ (w - start))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - target) + 1e-3 * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        while np.abs(step).max() > 1e-12 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
        if np.abs(step).max() <= 1e-10:
            break
    return float(w[0]), float(w[1])


def labelled_documents(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text, y, part of the sampled documents, a row an id, so no more than the sample has. Its ids are broadcast: their number is a parameter."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "y", "part")).alias("r"))
    return one.select("doc_id", "r.text", "r.y", "r.part")


def _vectors(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """label, features: the sparse rows as vectors, saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, VECTOR_ROWS) for whole in textops.long_rows(batches) for at in range(0, whole.num_rows, VECTOR_ROWS)):
            made = [r for part in doc_stats.over_batch(b.column("text"), lambda d, o: sparse_rows(doc_stats.TextFacts(d, o))) for r in part]
            bounds = pa.array(np.concatenate(([0], np.cumsum([len(i) for i, _ in made]))), pa.int32())
            index, value = pa.array(np.concatenate([i for i, _ in made]), pa.int32()), pa.array(np.concatenate([x for _, x in made]))
            vector = pa.StructArray.from_arrays(
                [pa.array(np.zeros(len(made)), pa.int8()), pa.array(np.full(len(made), N_KINDS << BITS), pa.int32()), pa.ListArray.from_arrays(bounds, index), pa.ListArray.from_arrays(bounds, value)],
                names=["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.float64()), vector], names=["label", "features"])

    made = rows.select("text", "y").mapInArrow(run, "label double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")
    return scratch.save(made, "vectors", read_as=StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))


def _fit(vectors: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean log loss plus L2 / 2 times the squared weights, each times its feature's deviation."""
    fitted = LogisticRegression(maxIter=STEPS, tol=TOLERANCE, regParam=L2, standardization=True, family="binomial", maxBlockSizeInMB=0.25).fit(vectors)
    return fitted.coefficients.toArray(), float(fitted.intercept)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, keep: Column | None = None) -> QualityModel:
    """Fits on a bounded sample of labelled documents (``keep``: of those labels only)."""
    sample = labelled_sample(labels, limit, keep)
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(labelled_documents(docs, sample), "labelled")
    try:
        seen = {(r["aside"], r["y"]): r["count"] for r in found.groupBy((F.col("part") == 0).alias("aside"), "y").count().collect()}
        if not {(False, 0), (False, 1)} <= set(seen):
            return KEEP_ALL
        vectors = _vectors(found.where("part <> 0"), scratch)
        weights, shift = _fit(vectors)
        scratch.drop(vectors)
        if not {(True, 0), (True, 1)} <= set(seen):
            return QualityModel(weights, 1.0, shift)

        def margin_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in textops.long_rows(batches):
                m = np.concatenate(doc_stats.over_batch(b.column("text"), lambda d, o: margins(doc_stats.TextFacts(d, o), weights)))
                yield pa.RecordBatch.from_arrays([pa.array(m), b.column("y")], names=["margin", "y"])

        held = found.where("part = 0").select("y", "text").mapInArrow(margin_of, "margin double, y int").collect()  # a part of the bounded sample
        slope, intercept = _platt(np.array([r["margin"] for r in held]) + shift, np.array([r["y"] for r in held], float))
        return QualityModel(weights, slope, intercept + slope * shift)
    finally:
        scratch.drop(found)


def _judged(b: pa.RecordBatch, model: QualityModel) -> dict[str, np.ndarray]:
    def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        f = doc_stats.TextFacts(data, offsets)
        return f.base() | {"probability": model.probability(f)}

    parts = doc_stats.over_batch(b.column("text"), measure)
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["probability"] >= THRESHOLD)
    return out


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def judge_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the calibrated probability of good quality, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            out = _judged(b, model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[c]) for c in COLUMNS)], names=["doc_id", *COLUMNS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def filter_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textops.long_rows(batches):
            yield b.filter(pa.array(_judged(b, model)["kept"]))

    return docs.mapInArrow(run, docs.schema)
