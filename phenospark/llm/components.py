"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenospark.runtime import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: every node's neighbours (the smaller ones only, if ``small``) point to its least neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("a"), "m").unionByName(least.select("a", "m"))
    else:
        out = joined.where("b > a").select(F.col("b").alias("a"), "m")
    return out.where("a != m").select("a", F.col("m").alias("b")).distinct()


def components(edges: DataFrame, slot: str = "components") -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component's name is its least node.

    Nodes are longs. Each round keeps (larger, smaller) pairs only and is written, so that lineage
    stays short; rounds grow with the logarithm of the number of nodes. No node's neighbours are
    gathered: a step is a minimum per node joined back to the edges.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = materialize(edges, "edges"), None
    for _ in range(200):
        edges = materialize(_star(_star(edges, False), True), "edges")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == mark:
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        mark = now
    raise RuntimeError("components did not settle in 200 rounds")
