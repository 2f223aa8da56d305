"""Parquet layouts of tensors, profiles and factor matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenospark.operators.axis import Axis
from phenospark.operators.tensor import RecordTensor
from phenospark.schema import AXES


def write_tensor(tensor: RecordTensor, folder: str) -> None:
    """Entries, sizes and the three dictionaries under one folder."""
    spark = tensor.entries.sparkSession
    tensor.entries.write.parquet(f"{folder}/entries")
    spark.createDataFrame([tuple(tensor.dims[a] for a in AXES)], ", ".join(f"n_{a} bigint" for a in AXES)) \
        .write.parquet(f"{folder}/dims")
    for name, axis in tensor.axes.items():
        axis.table.select("key", "idx").write.parquet(f"{folder}/axis_{name}")


def read_tensor(spark: SparkSession, folder: str) -> RecordTensor:
    dims = spark.read.parquet(f"{folder}/dims").first()
    axes = {a: Axis(a, spark.read.parquet(f"{folder}/axis_{a}"), dims[f"n_{a}"]) for a in AXES}
    return RecordTensor(spark.read.parquet(f"{folder}/entries"), axes)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profiles ``(axis, k, idx, prob)``, one folder per axis and component.

    Rows are first brought together by axis and component and by blocks of the index, so a
    component's long axis is written by several tasks.
    """
    block = F.floor(F.col("idx") / F.lit(1_000_000))
    profiles.repartition("axis", "k", block).write.partitionBy("axis", "k").parquet(path)


def read_profiles(spark: SparkSession, path: str, axis: str | None = None, k: int | None = None) -> DataFrame:
    """Profiles, optionally of one axis or component; only the matching folders are read."""
    df = spark.read.schema("idx bigint, prob double, axis string, k bigint").parquet(path)
    if axis is not None:
        df = df.where(F.col("axis") == axis)
    if k is not None:
        df = df.where(F.col("k") == k)
    return df.select("axis", "k", "idx", "prob")


def write_factors(factors: DataFrame, path: str) -> None:
    """Factor matrices ``(mode, idx, r, value)``, one folder per mode."""
    factors.write.partitionBy("mode").parquet(path)


def read_factors(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    df = spark.read.schema("idx bigint, r int, value double, mode string").parquet(path)
    return (df if mode is None else df.where(F.col("mode") == mode)).select("mode", "idx", "r", "value")
