"""Clinical event views over the TPC-H-like tables, and the loader for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenospark.operators.joins import lookup


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def medication(spark: SparkSession, folder: str) -> DataFrame:
    """(subject_id, date, med_name): a brand shipped to a customer.

    Orders and parts have one row per key. Their sizes come from the file footers: small ones are
    broadcast, beyond that an order or part with very many lines is salted.
    """
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("date"))
    ordered = lookup(lines, orders, ["l_orderkey"], rows=orders.count())
    items = lookup(ordered, parts, ["l_partkey"], rows=parts.count(), measured=lines)
    return items.select(F.col("o_custkey").alias("subject_id"), "date", F.col("p_brand").alias("med_name"))


def diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    """(subject_id, date, code): the priority of a customer's order."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("code"),
    )


def lab(spark: SparkSession, folder: str) -> DataFrame:
    """(subject_id, date, test_name, value): a user's events."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("subject_id"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("test_name"),
        "value",
    )
