"""Agreement of clusters with classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach_labels(assigned: DataFrame, labels: DataFrame, on: str = "subject_id") -> DataFrame:
    """Keep the rows that have a label, with it."""
    return assigned.join(labels, on)


def purity(assigned: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """One row ``(purity, n)``: the share of rows in the largest class of their cluster."""
    cells = assigned.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("_n"))
    best = cells.groupBy(cluster).agg(F.max("_n").alias("_best"), F.sum("_n").alias("_all"))
    return best.agg(
        (F.sum("_best") / F.sum("_all")).alias("purity"), F.sum("_all").alias("n")
    )
