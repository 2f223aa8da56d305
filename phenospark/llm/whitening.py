"""Whitening of vectors by a covariance rebuilt from variances of dimensions and of pair sums.

Entries become whole numbers ``floor(1024 c) + 100000``, so every count, sum and square below is
exact. With n vectors and sums S, the scaled centred entry n*x - S is whole too. Tasks add up its
square for each dimension, and the square of the sum of each two dimensions (polarisation); since
var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of these give all covariances without a
product of two dimensions. Only d (d + 1) / 2 totals per task are shuffled and reach the driver,
which holds the d x d matrix and decomposes it.

Defined results: rows whose vector is null or empty, or holds a null or non-finite entry, are left
out. So are vectors of another length than the commonest (of equally common lengths, the longer).
Repeated rows and rows with equal keys each count and are each returned. An empty table gives an empty result. A
component without variance (up to rounding) has a null ``whitened`` and ``explained`` 0, and takes
no part in ``identity_error``. Input columns named like an output column are replaced, all others
are kept but for the vector. ``deviation`` is null if it has more than 38 digits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from phenospark.llm.common import prepare, unused
from phenospark.operators.vectors import block, lists
from phenospark.runtime import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Totals travel as whole numbers to this base, whose sums fit a 38-digit decimal.
LIMB = 60
#: Squares of numbers below 2^52 are added in halves of 26 bits over at most this many rows.
ROWS = 1024
OUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def whole(c: np.ndarray) -> np.ndarray:
    """The entries as whole numbers: int64, or Python integers where that is too narrow."""
    with np.errstate(over="ignore"):
        x = np.floor(c * SCALE)
    if not x.size or np.abs(x).max() < 2.0**52:
        return x.astype(np.int64) + SHIFT
    exact = [math.floor(Fraction(v) * SCALE) + SHIFT for v in c.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(c.shape)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact; int64 if all are below 2^51 (so that pair sums are below 2^52)."""
    widest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if x.dtype != object and widest < 1 << 62:
        y = x * n - np.array(sums, dtype=np.int64)
        if max(abs(int(y.max())), abs(int(y.min()))) < 1 << 51:
            return y
        x = x.astype(object)
    return x.astype(object) * n - np.array(sums, dtype=object)


def square_sums(y: np.ndarray) -> list[int]:
    """Sum of squares of each column, exact, for at most ``ROWS`` rows."""
    if y.dtype == object:
        return [int(v) for v in (y * y).sum(axis=0)]
    low, high = y & 0x3FFFFFF, y >> 26
    parts = ((high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0))
    return [(int(a) << 52) + (int(b) << 27) + int(c) for a, b, c in zip(*parts)]


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, part) with value = sum of part * 2^(60 place); parts have the sign of the value."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest or place == 0:
        yield place, sign * (rest & ((1 << LIMB) - 1))
        rest, place = rest >> LIMB, place + 1


def add_exactly(vectors: DataFrame, totals) -> dict[int, int]:
    """Sum over all tasks of the whole numbers {key: total} that ``totals`` gives for one task."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (block(b.column(0)) for b in batches if b.num_rows)
        found = [(key, place, part) for key, total in totals(blocks).items() for place, part in limbs(total)]
        key, place, part = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int32()), pa.array(place, pa.int32()), pa.array(part, pa.int64())], names=["key", "place", "part"])

    parts = vectors.mapInArrow(partial, "key int, place int, part bigint")
    summed = parts.groupBy("key", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[int, int] = defaultdict(int)
    for r in summed.collect():
        out[r["key"]] += int(r["total"]) << LIMB * r["place"]
    return out


@dataclass(frozen=True)
class Whitening:
    """n, sums S, eigenvalues (falling) and unit eigenvectors (columns) of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def used(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.values > np.finfo(float).eps * len(self.values) * max(self.values[0], 0.0)


def usable(vectors: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows with a whole vector of the table's length, and that length (0 without any)."""
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where((F.size(column) > 0) & F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size(column).alias("size")).count()
    best = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return (rows, 0) if best is None else (rows.where(F.size(column) == best["size"]), best["size"])


def fit(rows: DataFrame, d: int) -> Whitening | None:
    """The whitening of a one-column table of vectors with d entries; none without rows."""
    def sums(blocks: Iterator[np.ndarray]) -> dict[int, int]:
        out = dict.fromkeys(range(-1, d), 0)
        for c in blocks:
            out[-1] += len(c)
            for j, s in enumerate(whole(c).sum(axis=0)):
                out[j] += int(s)
        return out

    found = add_exactly(rows, sums)
    n, total = found.get(-1, 0), [found.get(j, 0) for j in range(d)]
    if not n:
        return None

    def squares(blocks: Iterator[np.ndarray]) -> dict[int, int]:
        """Key j d + k for the sum of dimensions j < k, j d + j for dimension j alone."""
        out: dict[int, int] = defaultdict(int)
        for c in blocks:
            for at in range(0, len(c), ROWS):
                y = centred(whole(c[at : at + ROWS]), n, total)
                for j, s in enumerate(square_sums(y)):
                    out[j * d + j] += s
                for j in range(d - 1):
                    for k, s in enumerate(square_sums(y[:, j, None] + y[:, j + 1 :]), start=j + 1):
                        out[j * d + k] += s
        return out

    v = add_exactly(rows, squares)
    cov = np.empty((d, d))
    for j in range(d):
        cov[j, j] = v[j * d + j] / n**3
        for k in range(j + 1, d):
            cov[j, k] = cov[k, j] = (v[j * d + k] - v[j * d + j] - v[k * d + k]) / (2 * n**3)
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    # one sign for all rows and reruns: the largest entry is positive
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(d)])
    return Whitening(n, total, values, directions, float(np.trace(cov)))


def transform(rows: DataFrame, column: str, model: Whitening, k: int) -> DataFrame:
    """Rows without the vector, with ``deviation`` decimal(38,0) and ``whitened`` array<double>."""
    used = model.used()[:k]
    scale = np.where(used, np.sqrt(np.where(used, model.values[:k], 1.0)), np.inf)
    matrix = model.vectors[:, :k] / scale
    kept = [c for c in rows.columns if c != column and c not in ("deviation", "whitened")]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = centred(whole(block(b.column(column))), model.n, model.sums)
            wide = y.astype(object) if y.dtype == object or np.abs(y).max() >= 1 << 27 else y
            far = [int(v) for v in (wide * wide).sum(axis=1)]
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
            whitened = lists((y.astype(np.float64) / model.n) @ matrix)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), deviation, whitened], names=[*kept, "deviation", "whitened"])

    return rows.mapInArrow(apply, schema)


def identity_error(whitened: DataFrame, used: list[bool]) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""
    at = [i for i, u in enumerate(used) if u]
    pairs = [(a, b) for a in at for b in at if a <= b]
    if not pairs:
        return 0.0
    w = F.col("whitened")
    mean = whitened.agg(*[F.avg(w[a]).alias(f"m{a}") for a in at]).first()
    moments = [F.avg((w[a] - mean[f"m{a}"]) * (w[b] - mean[f"m{b}"])) for a, b in pairs]
    row = whitened.agg(*[m.alias(f"c{i}") for i, m in enumerate(moments)]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(row, pairs))


def whiten(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component up to ``k``: its columns, component (from 1), n,
    deviation, whitened, explained, identity_error."""
    prepare(vectors.sparkSession)
    vectors = vectors.drop(*(c for c in vectors.columns if c in OUT and c != column))
    rows, d = usable(vectors, column)
    model = fit(rows.select(column), d) if d else None
    if model is None:
        empty = vectors.where("false").drop(column)
        return empty.select(
            "*", F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
            *(F.lit(0.0).alias(c) for c in OUT[3:]))
    k = min(k, d)
    table = materialize(transform(rows, column, model, k), "whitened")
    used = model.used()[:k].tolist()
    explained = [v / model.trace if u else 0.0 for v, u in zip(model.values[:k].tolist(), used)]
    name = unused(vectors, "_at")[0]
    cells = table.select(
        *[F.col(c) for c in table.columns if c != "whitened"], F.posexplode("whitened").alias(name, "whitened"))
    place = F.col(name)
    return cells.select(
        *[c for c in vectors.columns if c != column],
        (place + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        F.when(F.element_at(F.lit(used), place + 1), F.col("whitened")).alias("whitened"),
        F.element_at(F.lit(explained), place + 1).alias("explained"),
        F.lit(identity_error(table, used)).alias("identity_error"),
    )
