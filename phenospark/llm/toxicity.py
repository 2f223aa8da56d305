"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed character n-grams of its lower-cased, blank-collapsed
text. Over all labelled training rows, each feature's log ratio of the shares of toxic and other
documents that hold it is counted. Features in fewer than ``MIN_DOCS`` documents, or whose ratio
is near zero, are left out; the others, scaled by their ratios and each document to unit length,
go into a logistic regression. It is fitted on a bounded sample of the labelled rows (``max_fit``,
by hash of key and text) with toxic rows weighing ``TOXIC_WEIGHT``. Keys and labels are joined to
texts by checked size, no order is taken, and only the sample's feature numbers reach the task that
fits. Scoring sees the text alone and covers every document whole.

Defined cases: null and empty texts score by the intercept; labels that are null are not learnt
from; a document labelled more than once counts once per label row; without both classes every
score is the share of toxic labels (0 without labels); extra columns are kept and columns with an
output's name replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from phenospark.llm.bpe import replace_column, with_field
from phenospark.llm.common import prepare
from phenospark.operators.joins import lookup
from phenospark.runtime import materialize

BITS = 20
SIZES = (4, 5, 6)
MIN_DOCS = 5
LEAST_RATIO = 0.5
MAX_FIT = 6000
TOXIC_WEIGHT = 4.0
STEPS, RATE, PENALTY = 80, 0.5, 1e-4


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    chars = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(chars) <= 2:
        return np.empty(0, np.int64)
    found, h = [], chars
    for n in range(2, min(max(SIZES), len(chars)) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        if n in SIZES:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            found.append((x >> np.uint64(64 - BITS)).astype(np.int64))
    every = np.concatenate(found) if found else np.empty(0, np.int64)
    if len(every) < 4000:
        return np.unique(every)
    flags = np.zeros(1 << BITS, bool)
    flags[every] = True
    return np.flatnonzero(flags)


@dataclass(frozen=True)
class Model:
    """Log-count ratios (0 for features left out) and the weights of the scaled features; a fixed size."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = features(text)
        r = self.ratios[at]
        z = self.bias + float((r * self.weights[at]).sum()) / max(float(np.sqrt((r * r).sum())), 1e-12)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def held_out(key: Column) -> Column:
    """The fold that no training sees: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            sums[toxic][features(text)] += 1
    at = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["feature", "clean", "toxic"])


def log_ratios(train: DataFrame, n: dict[int, int], smooth: float = 1.0, min_docs: int = MIN_DOCS, least: float = LEAST_RATIO) -> np.ndarray:
    """Naive Bayes log-count ratio of every feature over all training rows (text, toxic), of which
    ``n`` are clean (0) and toxic (1)."""
    sums = train.mapInArrow(_counts, "feature bigint, clean bigint, toxic bigint").groupBy("feature")
    sums = sums.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = sums.where(F.col("clean") + F.col("toxic") >= min_docs).toPandas()
    r = np.log((rows.toxic + smooth) / (n[1] + 2 * smooth)) - np.log((rows.clean + smooth) / (n[0] + 2 * smooth))
    out = np.zeros(1 << BITS)
    out[rows.feature] = np.where(np.abs(r) >= least, r, 0.0)
    return out


class Regression:
    """Weighted logistic regression on sparse rows of unit length, by Adam over the whole sample."""

    def __init__(self, rows: list[np.ndarray], label: np.ndarray, ratios: np.ndarray):
        self.bounds = np.cumsum([0, *map(len, rows)])
        every = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.used, at = np.unique(every, return_inverse=True)
        self.at = at.astype(np.int32)
        scaled = ratios[every]
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.bounds))
        length = np.sqrt(np.bincount(self.row, scaled * scaled, len(rows)))
        self.value = scaled / np.maximum(length, 1e-12)[self.row]
        self.label = label
        share = np.where(label == 1, TOXIC_WEIGHT, 1.0)
        self.share = share / share.sum()

    def fit(self, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
        w, b = np.zeros(len(self.used)), 0.0
        mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, steps + 1):
            z = np.bincount(self.row, self.value * w[self.at], len(self.label)) + b
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - self.label) * self.share
            slope = np.append(np.bincount(self.at, self.value * error[self.row], len(w)) + penalty * w, error.sum())
            mean = 0.9 * mean + 0.1 * slope
            square = 0.999 * square + 0.001 * slope * slope
            move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return w, float(b)


def _fit_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, label = [], []
        for batch in batches:
            # in order of key and text, so that the sums round the same way in every run
            rows += [np.frombuffer(x, np.int32) for x in batch.column("kept").to_pylist()]
            label += batch.column("toxic").to_pylist()
        made = Regression(rows, np.array(label, np.float64), shared.value)
        w, b = made.fit()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(made.used, -1)), pa.array(np.append(w, b))], ["feature", "weight"])

    return run


def _kept_features(shared):
    """Feature numbers that have a ratio, as bytes: far less than the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            kept = [at[shared.value[at] != 0].astype(np.int32).tobytes() for at in found]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(kept, pa.binary()), batch.column("toxic")], ["h", "kept", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from the labelled documents outside the held-out fold: counts from all of them, the
    regression from about ``max_fit``, which one task holds as feature numbers."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("toxic"))
    texts = docs.where(~held_out(F.col(key))).select(F.col(key).alias("key"), F.col(text).alias("text"))
    train = materialize(lookup(texts, known, ["key"], rows=known.count(), row_bytes=24), "labelled")
    classes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        share = float(next(iter(classes), 0))
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 60.0 if share else -60.0)
    ratios = log_ratios(train, classes, min_docs=min_docs)
    shared = spark.sparkContext.broadcast(ratios)
    u = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    sample = train.withColumn("h", F.xxhash64("key", "text")).where(u < min(1.0, max_fit / sum(classes.values())))
    numbers = sample.select("h", "text", "toxic").mapInArrow(_kept_features(shared), "h bigint, kept binary, toxic int")
    fitted = numbers.repartition(1).sortWithinPartitions("h", "kept", "toxic").mapInArrow(_fit_rows(shared), "feature bigint, weight double").toPandas()
    weights = np.zeros(1 << BITS)
    inner = fitted[fitted.feature >= 0]
    weights[inner.feature] = inner.weight
    return Model(ratios, weights, float(fitted[fitted.feature < 0].weight.iloc[0]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every document, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield replace_column(batch, out, pa.array([shared.value.score(t) for t in batch.column(text).to_pylist()], pa.float64()))

    return docs.mapInArrow(run, with_field(docs.schema, out, DoubleType()))
