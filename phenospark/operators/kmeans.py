"""K-means: assignment and one update from given centres, and full fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.sql import DataFrame, functions as F

from phenospark.operators.vectors import block


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    distance = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
    return distance.argmin(axis=1)


def kmeans_assign(df: DataFrame, column: str, centers: np.ndarray, out: str = "cluster") -> DataFrame:
    """Index of the nearest centre of each vector; ties go to the lowest index."""
    centers = np.asarray(centers, dtype=np.float64)

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        x = block(column)
        return pa.array(_nearest(x, centers).astype(np.int32) if len(x) else np.array([], dtype=np.int32))

    return df.withColumn(out, nearest(column))


def kmeans_step(df: DataFrame, column: str, centers: np.ndarray) -> DataFrame:
    """One Lloyd step: (cluster, dim, n, center) after assigning to the given centres.

    Every task adds up its own blocks, so only clusters x dimensions numbers per task are shuffled.
    """
    centers = np.asarray(centers, dtype=np.float64)
    k, d = centers.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d)), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = block(batch.column(0))
            if len(x):
                member = np.eye(k)[_nearest(x, centers)]
                total += member.T @ x
                count += member.sum(axis=0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(k, dtype=np.int32), d)),
            pa.array(np.tile(np.arange(d, dtype=np.int32), k)),
            pa.array(np.repeat(count, d)),
            pa.array(total.ravel()),
        ], names=["cluster", "dim", "n", "s"])

    parts = df.select(column).mapInArrow(partial, "cluster int, dim int, n bigint, s double")
    sums = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    return sums.select("cluster", "dim", "n", (F.col("s") / F.col("n")).alias("center"))


def kmeans_lloyd(
    df: DataFrame, column: str, centers: np.ndarray, tol: float = 1e-4, max_iter: int = 20
) -> tuple[np.ndarray, int]:
    """Lloyd steps from given centres until none moves further than ``tol``; also how many were made.
    A centre without vectors stays where it is."""
    centers = np.array(centers, dtype=np.float64)
    for step in range(1, max_iter + 1):
        new = centers.copy()
        for r in kmeans_step(df, column, centers).collect():
            new[r["cluster"], r["dim"]] = r["center"]
        moved = np.sqrt(((new - centers) ** 2).sum(axis=1)).max()
        centers = new
        if moved <= tol:
            return centers, step
    return centers, max_iter


def kmeans_fit(vectors: DataFrame, column: str = "features", k: int = 3, max_iter: int = 20, seed: int = 1) -> KMeansModel:
    """Spark's own k-means."""
    return KMeans(featuresCol=column, predictionCol="cluster", k=k, maxIter=max_iter, seed=seed).fit(vectors)
