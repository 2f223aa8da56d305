"""Patient features: counts and averages, vectors, and scaling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F

from phenospark.operators.axis import Axis, build_axis, encode_axis
from phenospark.operators.joins import lookup
from phenospark.runtime import materialize


def filter_candidates(events: DataFrame, column: str, candidates: DataFrame) -> DataFrame:
    """Events whose item, lower-cased, is in the candidate table ``(item)``.

    The candidates' number and bytes are measured: a short list is sent to the events, which then
    stay where they are. Against a longer one the events meet by item, frequent items in pieces.
    """
    wanted = materialize(candidates.select(F.lower("item").alias("_item")).dropna().distinct(), "candidates")
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_item")), F.lit(0)).alias("b")).first()
    keyed = events.withColumn("_item", F.lower(events[column]))
    return lookup(keyed, wanted, ["_item"], "left_semi", rows=size["n"], row_bytes=40 + size["b"] // max(size["n"], 1)).drop("_item")


def _tuples(events: DataFrame, item: str, value, source: str, candidates: DataFrame | None) -> DataFrame:
    if candidates is not None:
        events = filter_candidates(events, item, candidates)
    return events.groupBy("subject_id", item).agg(value.cast("double").alias("value")).select(
        "subject_id", F.lit(source).alias("source"), F.col(item).alias("feature"), "value")


def diagnostic_features(diagnostic: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """How often each code was recorded: (subject_id, source, feature, value)."""
    return _tuples(diagnostic, "code", F.count(F.lit(1)), "diagnostic", candidates)


def medication_features(medication: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """How often each medication was given."""
    return _tuples(medication, "med_name", F.count(F.lit(1)), "medication", candidates)


def lab_features(lab: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Average value of each test."""
    return _tuples(lab, "test_name", F.avg("value"), "lab", candidates)


def assemble_features(*parts: DataFrame) -> DataFrame:
    """All feature tuples in one table; duplicates are kept."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def feature_axis(tuples: DataFrame) -> Axis:
    """Index of the features. The key is source and name, so equal names of two sources differ."""
    return build_axis(tuples.select(F.struct("source", "feature").alias("f")), "f", "feature")


def feature_matrix_long(tuples: DataFrame, axis: Axis | None = None) -> DataFrame:
    """(subject_id, idx, value): the non-zero cells of the patient x feature matrix."""
    if axis is None:
        tuples = materialize(tuples, "feature_tuples")
        axis = feature_axis(tuples)
    keyed = tuples.select("subject_id", F.struct("source", "feature").alias("f"), "value")
    return encode_axis(keyed, axis, "f", "idx").select("subject_id", "idx", "value")


def feature_vectors(tuples: DataFrame) -> tuple[DataFrame, Axis]:
    """One sparse vector per patient: (subject_id, features). A patient's list is at most as long
    as the feature dictionary, because tuples are unique per patient and feature."""
    stored = materialize(tuples, "feature_tuples")
    axis = feature_axis(stored)
    size = axis.size

    @F.pandas_udf(VectorUDT())
    def sparse(indices: pd.Series, values: pd.Series) -> pd.DataFrame:
        # the fields of Spark's vector type; type 0 is sparse
        return pd.DataFrame({"type": np.int8(0), "size": np.int32(size), "indices": indices, "values": values})

    cells = feature_matrix_long(stored, axis).groupBy("subject_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "value"))).alias("c"))
    return cells.select("subject_id", sparse("c.idx", "c.value").alias("features")), axis


def scale_vectors(vectors: DataFrame, column: str = "features", out: str = "scaled") -> DataFrame:
    """Scale every dimension to unit standard deviation without centring; a constant one becomes 0."""
    return StandardScaler(inputCol=column, outputCol=out).fit(vectors).transform(vectors)


def scale_features(matrix: DataFrame, n_features: int | None = None) -> DataFrame:
    """The same on the long matrix, where cells that are absent count as zeros.

    Per feature, with m cells among n patients, the squared deviations add up to
    m * (population variance of the cells + mean^2 * (1 - m / n)).
    """
    n = matrix.agg(F.count_distinct("subject_id").cast("double")).scalar()
    stats = matrix.groupBy("idx").agg(
        F.count(F.lit(1)).alias("_m"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var")
    ).withColumn("_n", n)
    squares = F.col("_m") * (F.col("_var") + F.col("_mean") ** 2 * (1.0 - F.col("_m") / F.col("_n")))
    deviation = F.sqrt(squares / (F.col("_n") - 1.0))
    sizes = stats.select("idx", deviation.alias("_sd"))
    scaled = F.when(F.col("_sd") > 0, F.col("value") / F.col("_sd")).otherwise(F.lit(0.0))
    return lookup(matrix, sizes, ["idx"], rows=n_features).select("subject_id", "idx", scaled.alias("value"))
