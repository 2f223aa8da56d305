"""Arrow blocks of vectors, and per-dimension statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def block(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float matrix, without a Python loop over its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count or column.flatten().null_count:
        raise ValueError("vectors must not be null or hold nulls")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    widths = np.diff(column.offsets.to_numpy())
    if (widths != widths[0]).any():
        raise ValueError(f"vectors must have one length, found {sorted(set(widths.tolist()))[:5]}")
    return flat.reshape(len(column), widths[0])


def lists(matrix: np.ndarray) -> pa.Array:
    """A float matrix as a list column."""
    if not matrix.size:
        return pa.array([], pa.list_(pa.float64()))
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def dimension_stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Mean and biased variance of each dimension: (by..., dim, n, mean, var).

    Partial aggregates leave one row per dimension and task before the shuffle.
    """
    by = by or []
    cells = df.select(*by, F.posexplode(column).alias("dim", "x"))
    x = F.col("x").cast("double")
    return cells.groupBy(*by, "dim").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def vector_mean(df: DataFrame, column: str) -> DataFrame:
    """(dim, mean)."""
    return dimension_stats(df, column).select("dim", "mean")


def diag_covariance(df: DataFrame, column: str) -> DataFrame:
    """(dim, var): the diagonal covariance start, with biased variances."""
    return dimension_stats(df, column).select("dim", "var")


def collect_matrix(cells: DataFrame, row: str, value: str) -> np.ndarray:
    """A small (row, dim, value) table, components x dimensions, as a driver matrix."""
    rows = cells.select(row, "dim", value).collect()
    ids = sorted({r[0] for r in rows})
    width = max(r[1] for r in rows) + 1
    place = {k: i for i, k in enumerate(ids)}
    out = np.zeros((len(ids), width))
    for r in rows:
        out[place[r[0]], r[1]] = r[2]
    return out
