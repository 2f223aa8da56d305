"""Scale, cluster in two ways, and score both against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenospark.operators.features import feature_vectors, scale_vectors
from phenospark.operators.kmeans import kmeans_fit
from phenospark.operators.metrics import attach_labels, purity
from phenospark.operators.mixture import gmm_fit
from phenospark.runtime import materialize


def compare_clusterings(labels: DataFrame, feature_sets: dict[str, DataFrame], k: int = 3, seed: int = 1) -> DataFrame:
    """(feature_set, method, purity, n) for k-means and the Gaussian mixture on each feature set.

    Models are fitted on all patients; purity counts those that have a label. The scaled vectors
    are written once per feature set, because both fits pass over them many times.
    """
    out = None
    for name, tuples in feature_sets.items():
        # the scaler reads them twice
        vectors = materialize(feature_vectors(tuples)[0], f"vectors_{name}")
        scaled = materialize(scale_vectors(vectors).select("subject_id", "scaled"), f"scaled_{name}")
        for method, fit in (("kmeans", kmeans_fit), ("gmm", gmm_fit)):
            model = fit(scaled, "scaled", k=k, seed=seed)
            assigned = model.transform(scaled).select("subject_id", "cluster")
            row = purity(attach_labels(assigned, labels)).select(
                F.lit(name).alias("feature_set"), F.lit(method).alias("method"), "purity", "n")
            out = row if out is None else out.unionByName(row)
    return out
