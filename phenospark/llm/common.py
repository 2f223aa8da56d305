"""Shared column expressions and small helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phenospark.runtime import ship_package

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column | str) -> Column:
    """The words of a text as an array; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column | str) -> Column:
    return F.size(words(text)).cast("bigint")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def prepare(spark: SparkSession, rows: int = 512) -> None:
    """Ship the package to Python workers and keep Arrow batches of long texts small.

    A batch is counted in rows; the default of 10,000 would let a few long texts fill a worker.
    """
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) != rows:
        spark.conf.set(name, str(rows))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
