"""Named queries over the TPC-H-like tables: one per operator.

Queries that start from the encoded records share one prepared copy per session and folder, as
the stages of the pipeline share files; the queries that build it never use that copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from phenospark.functions.rand import uniform
from phenospark.functions.scalars import argmax_component, binarize, relative_day, rescale, shift_index, table_name_of
from phenospark.operators import counts as C
from phenospark.operators import features as FT
from phenospark.operators import gibbs as G
from phenospark.operators import kmeans as KM
from phenospark.operators import mixture as MX
from phenospark.operators import ncp as N
from phenospark.operators import tensor as T
from phenospark.operators import vectors as V
from phenospark.operators import visits as VS
from phenospark.operators.axis import build_axis, compact_components, decode_axis
from phenospark.operators.cohort import CohortRules, label_cohort
from phenospark.operators.metrics import attach_labels, purity
from phenospark.plans import proxy
from phenospark.plans.compare import compare_clusterings
from phenospark.runtime import materialize, scratch_root, ship_package
from phenospark.schema import AXES
from phenospark.sources import csv as CSV
from phenospark.sources import tables as ST
from phenospark.sources import triplets as TX

RULES = CohortRules(
    target_codes=("1-URGENT", "2-HIGH"),
    excluded_codes=("5-LOW",),
    related_codes=("1-URGENT",),
    target_drugs=("Brand#11", "Brand#12", "Brand#13"),
    excluded_drugs=("Brand#21", "Brand#22"),
    screening_tests=("view", "click"),
    abnormal_above={"purchase": 200.0, "error": 250.0},
)

Query = Callable[[SparkSession, str], DataFrame]


# ---- inputs -------------------------------------------------------------------------------------

def _events(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return proxy.medication(spark, folder), proxy.diagnostic(spark, folder)


@dataclass(frozen=True)
class _Prepared:
    tensor: T.RecordTensor
    records: DataFrame
    assigned: DataFrame
    counts: DataFrame
    dims: dict[str, int]
    priors: C.Priors


_prepared: dict[tuple[str, str], _Prepared] = {}


def _prepare(spark: SparkSession, folder: str) -> _Prepared:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _prepared:
        ship_package(spark)
        tensor = T.build_tensor(*_events(spark, folder))
        records = materialize(T.number_records(tensor), "records")
        tensor = T.RecordTensor(records.drop("rec_id"), tensor.axes)
        assigned = materialize(C.init_assignments(records.select("rec_id", *AXES)), "assigned")
        counts = materialize(C.component_counts(assigned), "counts")
        _prepared[key] = _Prepared(tensor, records, assigned, counts, tensor.dims, C.Priors.from_dims(tensor.dims))
    return _prepared[key]


def _candidates(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Items whose mean is above the overall mean: brands and codes by price, tests by value."""
    def above(df: DataFrame, item: str, value: str) -> DataFrame:
        overall = df.agg(F.avg(value)).scalar()
        means = df.groupBy(item).agg(F.avg(value).alias("_m"))
        return means.where(F.col("_m") > overall).select(F.col(item).alias("item"))

    return {
        "med": above(proxy.table(spark, folder, "part"), "p_brand", "p_retailprice"),
        "code": above(proxy.table(spark, folder, "orders"), "o_orderpriority", "o_totalprice"),
        "test": above(proxy.table(spark, folder, "events"), "event_type", "value"),
    }


def _feature_tuples(spark: SparkSession, folder: str, filtered: bool = False) -> DataFrame:
    med, diag = _events(spark, folder)
    c = _candidates(spark, folder) if filtered else {}
    return FT.assemble_features(
        FT.diagnostic_features(diag, c.get("code")),
        FT.lab_features(proxy.lab(spark, folder), c.get("test")),
        FT.medication_features(med, c.get("med")),
    )


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return proxy.table(spark, folder, "embeddings")


def _class_mixture(vectors: DataFrame) -> MX.Mixture:
    """Three components from the vectors of each residue of the class number."""
    grouped = vectors.withColumn("g", F.pmod("label", F.lit(3)))
    stats = materialize(V.dimension_stats(grouped, "embedding", ["g"]), "class_stats")
    n = V.collect_matrix(stats, "g", "n")[:, 0]
    return MX.Mixture(n / n.sum(), V.collect_matrix(stats, "g", "mean"), V.collect_matrix(stats, "g", "var"))


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _out(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}_{uuid.uuid4().hex[:8]}"


# ---- visits and tensor --------------------------------------------------------------------------

def relative_days(spark, folder):
    return proxy.medication(spark, folder).select("subject_id", "med_name", relative_day("date").alias("day"))


def asof_visit(spark, folder):
    return VS.assign_visit_day(*_events(spark, folder))


def _asof_visit(strategy: str) -> Query:
    def run(spark, folder):
        return VS.assign_visit_day(*_events(spark, folder), strategy=strategy)
    return run


def visits(spark, folder):
    v = VS.build_visits(*_events(spark, folder))
    return v.select("subject_id", "day", F.array_join("codes", ",").alias("codes"), F.array_join("meds", ",").alias("meds"))


def visit_pairs(spark, folder):
    return VS.visit_pairs(*_events(spark, folder))


def _axis(column: str) -> Query:
    def run(spark, folder):
        return build_axis(VS.visit_pairs(*_events(spark, folder)), column, column).table
    return run


def _tensor(multiplicity: str) -> Query:
    def run(spark, folder):
        return T.build_tensor(*_events(spark, folder), multiplicity=multiplicity).entries.select(*AXES, "value")
    return run


def tensor_dims(spark, folder):
    return T.tensor_dims(_prepare(spark, folder).tensor.entries)


def decode_triplets(spark, folder):
    p = _prepare(spark, folder)
    rows = decode_axis(p.records, p.tensor.axes["diag"], "diag", "code")
    rows = decode_axis(rows, p.tensor.axes["med"], "med", "med_name")
    rows = decode_axis(rows, p.tensor.axes["patient"], "patient", "subject_id")
    return rows.select("subject_id", "day", "code", "med_name")


def triplet_columns(spark, folder):
    return T.triplet_columns(_prepare(spark, folder).tensor.entries)


def table_names(spark, folder):
    return proxy.table(spark, folder, "pages").select("page_id", table_name_of("url").alias("name"))


def binarized(spark, folder):
    rows = rescale(proxy.table(spark, folder, "events").select("event_id", "value"), "value", "scaled")
    return _round(rows.withColumn("bit", binarize("scaled")), 9, "scaled", "bit")


# ---- features and labels ------------------------------------------------------------------------

def _one_feature(which: str, filtered: bool) -> Query:
    def run(spark, folder):
        c = _candidates(spark, folder) if filtered else {}
        if which == "diag":
            out = FT.diagnostic_features(proxy.diagnostic(spark, folder), c.get("code"))
        elif which == "med":
            out = FT.medication_features(proxy.medication(spark, folder), c.get("med"))
        else:
            out = FT.lab_features(proxy.lab(spark, folder), c.get("test"))
        return _round(out, 6, "value")
    return run


def features_union(spark, folder):
    return _round(_feature_tuples(spark, folder), 6, "value")


def feature_matrix(spark, folder):
    return _round(FT.feature_matrix_long(_feature_tuples(spark, folder)), 6, "value")


def feature_vectors(spark, folder):
    ship_package(spark)
    vectors, _ = FT.feature_vectors(_feature_tuples(spark, folder))
    cells = vectors.select("subject_id", F.posexplode(vector_to_array("features")).alias("idx", "value"))
    return _round(cells.where("value <> 0").select("subject_id", F.col("idx").cast("bigint").alias("idx"), "value"), 6, "value")


def scaled_features(spark, folder):
    tuples = materialize(_feature_tuples(spark, folder), "tuples")
    axis = FT.feature_axis(tuples)
    matrix = materialize(FT.feature_matrix_long(tuples, axis), "matrix")
    return _round(FT.scale_features(matrix, axis.size), 6, "value")


def scaled_vectors(spark, folder):
    ship_package(spark)
    vectors, _ = FT.feature_vectors(_feature_tuples(spark, folder))
    scaled = FT.scale_vectors(materialize(vectors, "vectors"))
    cells = scaled.select("subject_id", F.posexplode(vector_to_array("scaled")).alias("idx", "value"))
    return _round(cells.where("value <> 0").select("subject_id", F.col("idx").cast("bigint").alias("idx"), "value"), 6, "value")


def _labels(spark, folder):
    return label_cohort(proxy.medication(spark, folder), proxy.lab(spark, folder), proxy.diagnostic(spark, folder), RULES)


def cohort_labels(spark, folder):
    return _labels(spark, folder)


# ---- clustering ---------------------------------------------------------------------------------

def kmeans_assign(spark, folder):
    v = _vectors(spark, folder)
    return KM.kmeans_assign(v, "embedding", _class_mixture(v).means).select("vec_id", "cluster")


def kmeans_step(spark, folder):
    v = _vectors(spark, folder)
    return _round(KM.kmeans_step(v, "embedding", _class_mixture(v).means), 6, "center")


def kmeans_lloyd(spark, folder):
    v = _vectors(spark, folder)
    centers, _ = KM.kmeans_lloyd(v, "embedding", _class_mixture(v).means)
    return KM.kmeans_assign(v, "embedding", centers).select("vec_id", "cluster")


def cluster_purity(spark, folder):
    v = _vectors(spark, folder)
    labels = v.select("vec_id", "label")
    assigned = KM.kmeans_assign(v, "embedding", _class_mixture(v).means).select("vec_id", "cluster")
    return _round(purity(attach_labels(assigned, labels, "vec_id")), 9, "purity")


def vector_mean(spark, folder):
    return _round(V.vector_mean(_vectors(spark, folder), "embedding"), 9, "mean")


def diag_cov(spark, folder):
    return _round(V.diag_covariance(_vectors(spark, folder), "embedding"), 9, "var")


def gmm_resp(spark, folder):
    v = _vectors(spark, folder)
    r = MX.gmm_responsibilities(v, "embedding", _class_mixture(v))
    return _round(r.select("vec_id", F.posexplode("resp").alias("k", "resp")), 6, "resp")


def gaussian_logpdf(spark, folder):
    v = _vectors(spark, folder)
    r = MX.gaussian_logpdf(v, "embedding", _class_mixture(v))
    return _round(r.select("vec_id", F.posexplode("logpdf").alias("k", "logpdf")), 6, "logpdf")


def argmax(spark, folder):
    v = _vectors(spark, folder)
    r = MX.gmm_responsibilities(v, "embedding", _class_mixture(v))
    return r.select("vec_id", argmax_component("resp").alias("cluster"))


def gmm_step(spark, folder):
    v = _vectors(spark, folder)
    return _round(MX.gmm_step(v, "embedding", _class_mixture(v)), 6, "weight", "mean", "var", "log_likelihood")


def gmm_init(spark, folder):
    start = MX.gmm_init(_vectors(spark, folder), "vec_id", "embedding", k=3, seed=1)
    rows = [
        (k, d, float(start.weights[k]), float(start.means[k, d]), float(start.covariances[k, d]))
        for k, d in np.ndindex(*start.means.shape)
    ]
    out = spark.createDataFrame(rows, "k int, dim int, weight double, mean double, var double")
    return _round(out, 9, "weight", "mean", "var")


def gmm_fit_diagonal(spark, folder):
    v = _vectors(spark, folder)
    model, _ = MX.gmm_fit_diagonal(v, "embedding", _class_mixture(v))
    r = MX.gmm_responsibilities(v, "embedding", model)
    return r.select("vec_id", argmax_component("resp").alias("cluster"))


def _line_vectors(spark, folder, singular: bool = False) -> DataFrame:
    """Three scaled measures of every order line, grouped by return flag; the singular form adds
    the sum of the first and the third as a fourth."""
    ship_package(spark)
    lines = proxy.table(spark, folder, "lineitem")
    x = [F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000, F.col("l_discount") * 10]
    group = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return lines.select("l_orderkey", "l_linenumber", group.alias("g"), F.array(*x, *([x[0] + x[2]] if singular else [])).alias("x"))


def _logpdf_full(singular: bool) -> Query:
    def run(spark, folder):
        v = _line_vectors(spark, folder, singular)
        r = MX.gaussian_logpdf(v, "x", MX.group_mixture(v, "x", "g", 3))
        return _round(r.select("l_orderkey", "l_linenumber", F.posexplode("logpdf").alias("k", "logpdf")), 6, "logpdf")
    return run


def _step_full(singular: bool) -> Query:
    def run(spark, folder):
        v = _line_vectors(spark, folder, singular)
        step = MX.gmm_step_full(v, "x", MX.group_mixture(v, "x", "g", 3))
        return _round(step.withColumn("log_likelihood", F.round("log_likelihood", 3)), 6, "weight", "mean", "cov")
    return run


def gmm_fit_full(spark, folder):
    """Full-covariance EM from the return flags to its end: one row per order line."""
    v = _line_vectors(spark, folder)
    model, _ = MX.gmm_fit_full(v, "x", MX.group_mixture(v, "x", "g", 3))
    r = MX.gmm_responsibilities(v, "x", model)
    return r.select("l_orderkey", "l_linenumber", argmax_component("resp").alias("cluster"))


def _all_vectors(spark, folder):
    """Scaled vectors of all three feature sources."""
    ship_package(spark)
    vectors, _ = FT.feature_vectors(_feature_tuples(spark, folder))
    return materialize(FT.scale_vectors(materialize(vectors, "vectors")).select("subject_id", "scaled"), "scaled")


def kmeans_fit(spark, folder):
    v = _all_vectors(spark, folder)
    return KM.kmeans_fit(v, "scaled").transform(v).select("subject_id", "cluster")


def gmm_fit(spark, folder):
    v = _all_vectors(spark, folder)
    return MX.gmm_fit(v, "scaled", k=3).transform(v).select("subject_id", "cluster")


def clusterings(spark, folder):
    ship_package(spark)
    sets = {"all": _feature_tuples(spark, folder), "filtered": _feature_tuples(spark, folder, True)}
    return compare_clusterings(materialize(_labels(spark, folder), "labels"), sets)


# ---- counts, sweeps, profiles -------------------------------------------------------------------

def init_assignments(spark, folder):
    return C.init_assignments(_prepare(spark, folder).records).select("rec_id", *AXES, "k")


def component_counts(spark, folder):
    return C.component_counts(_prepare(spark, folder).assigned)


def component_weights(spark, folder):
    p = _prepare(spark, folder)
    return _round(C.component_weights(p.assigned, p.counts, p.dims, p.priors), 12, "weight")


def component_posterior(spark, folder):
    p = _prepare(spark, folder)
    return _round(C.component_weights(p.assigned, p.counts, p.dims, p.priors, normalise=True), 9, "prob")


def draw_category(spark, folder):
    p = _prepare(spark, folder)
    totals = C.live_totals(p.counts)
    rows = C.attach_counts(p.assigned, p.counts, p.dims, [k for k, _ in totals])
    rows = rows.select("rec_id", C.weight_array(totals, p.dims, p.priors).alias("w"))
    return rows.select("rec_id", C.draw_category("w", uniform("rec_id", 1, 1)).alias("at"))


def _frozen(p: _Prepared) -> DataFrame:
    return G.frozen_sweep(p.assigned, p.counts, p.dims, p.priors)


def frozen_sweep(spark, folder):
    return _frozen(_prepare(spark, folder))


def _sweep(mode: str) -> Query:
    def run(spark, folder):
        p = _prepare(spark, folder)
        return G.gibbs_sweep(p.assigned, p.dims, p.priors, mode).select("rec_id", "k")
    return run


def compacted(spark, folder):
    return compact_components(_frozen(_prepare(spark, folder)))


def applied_deltas(spark, folder):
    p = _prepare(spark, folder)
    after = _frozen(p).withColumnRenamed("k", "k_new")
    changed = materialize(p.assigned.join(after, "rec_id").where("k != k_new"), "changed")
    return C.apply_deltas(p.counts, changed.drop("k_new"), changed.drop("k").withColumnRenamed("k_new", "k"))


def _profile(axis: str) -> Query:
    def run(spark, folder):
        p = _prepare(spark, folder)
        return _round(C.profiles(p.counts, p.dims, p.priors, axis), 9, "prob")
    return run


def profiles_patient_sparse(spark, folder):
    """Of the long axis only the counted cells, and each component's probability of all others."""
    p = _prepare(spark, folder)
    return _round(C.sparse_profiles(p.counts, p.dims, p.priors, "patient"), 9, "prob")


def component_shares(spark, folder):
    return _round(C.component_shares(_prepare(spark, folder).counts), 9, "share")


def top_items(spark, folder):
    p = _prepare(spark, folder)
    top = C.top_items(C.profiles(p.counts, p.dims, p.priors, "med"))
    return _round(decode_axis(top, p.tensor.axes["med"], "idx", "med_name"), 9, "prob")


def score_triplets(spark, folder):
    p = _prepare(spark, folder)
    scored = C.score_triplets(p.records.select("rec_id", *AXES), p.counts, p.dims, p.priors)
    return scored.select("rec_id", F.round("score", 12).alias("score"))


def log_joint(spark, folder):
    p = _prepare(spark, folder)
    return _round(C.log_joint(p.counts, p.dims, p.priors), 4, "log_joint")


def dirichlet_draws(spark, folder):
    p = _prepare(spark, folder)
    return _round(C.dirichlet_draws(p.counts, p.dims, p.priors, "med", seed=1), 9, "prob")


_fits: dict[tuple[str, str], G.PhenotypeFit] = {}


def _fit(spark: SparkSession, folder: str) -> G.PhenotypeFit:
    """The full number of sweeps, its state kept every hundred; once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _fits:
        p = _prepare(spark, folder)
        _fits[key] = G.fit_phenotypes(p.records, p.dims, path=_out(spark, "fit"), commit_every=100)
    return _fits[key]


def fit_phenotypes(spark, folder):
    fit = _fit(spark, folder)
    top = C.top_items(C.profiles(fit.counts, fit.dims, fit.priors, "med"))
    return decode_axis(top, _prepare(spark, folder).tensor.axes["med"], "idx", "med_name").select("k", "rank", "med_name", "prob")


def fit_history(spark, folder):
    """Components in use and log joint after every sweep of that fit."""
    return _fit(spark, folder).history


# ---- factorisation ------------------------------------------------------------------------------

def _summed(p: _Prepared) -> DataFrame:
    return p.tensor.entries.groupBy(*AXES).agg(F.sum("value").alias("value"))


def _stepped(spark, p: _Prepared) -> tuple[DataFrame, N.Factors]:
    start = N.initial_factors(spark, p.dims)
    # drawn once, and of a size that Spark sees
    start = N.Factors({m: materialize(t, f"start_{m}") for m, t in start.tables.items()}, start.dims, start.rank)
    entries = materialize(_summed(p), "summed")
    updated = materialize(N.ncp_step(entries, start, "med").select("idx", "f"), "factor_med")
    return entries, N.Factors({**start.tables, "med": updated}, p.dims, start.rank)


def ncp_step(spark, folder):
    _, factors = _stepped(spark, _prepare(spark, folder))
    rows = factors.tables["med"].select("idx", F.posexplode("f").alias("r", "value"))
    return _round(rows, 9, "value")


def ncp_reconstruct(spark, folder):
    entries, factors = _stepped(spark, _prepare(spark, folder))
    return _round(N.ncp_reconstruct(entries, factors), 9, "model")


def ncp_mask(spark, folder):
    entries, factors = _stepped(spark, _prepare(spark, folder))
    return _round(N.ncp_mask(entries, factors), 6, "model", "scaled", "mask", "scaled_mask")


def ncp_fit(spark, folder):
    p = _prepare(spark, folder)
    factors, _ = N.ncp_fit(p.tensor.entries, p.dims)
    return _round(factors.long(), 6, "value")


def ncp_matrix_mask(spark, folder):
    """The vectors as a 0/1 matrix (a two-mode tensor): factorise, rebuild every cell, cut again."""
    v = _vectors(spark, folder)
    axis = build_axis(v, "vec_id", "vector")
    cells = decode_cells(v, axis)
    dims = {"row": axis.size, "col": v.agg(F.max(F.size("embedding"))).first()[0]}
    factors, _ = N.ncp_fit(cells, dims)
    return N.ncp_mask(cells, factors)


def decode_cells(vectors: DataFrame, axis) -> DataFrame:
    from phenospark.operators.axis import encode_axis

    coded = encode_axis(vectors.select("vec_id", "embedding"), axis, "vec_id", "row")
    cells = coded.select("row", F.posexplode("embedding").alias("col", "x"))
    bit = binarize(F.col("x").cast("double"), 0.0)
    return cells.select("row", F.col("col").cast("bigint").alias("col"), bit.alias("value"))


def top_factor_items(spark, folder):
    """The ten medications of largest value in every component."""
    p = _prepare(spark, folder)
    _, factors = _stepped(spark, p)
    rows = factors.tables["med"].select("idx", F.posexplode("f").alias("r", "value"))
    top = C.top_items(rows, by=("r",), value="value")
    return _round(decode_axis(top, p.tensor.axes["med"], "idx", "med_name"), 9, "value")


# ---- stored and read back -----------------------------------------------------------------------

def store_triplets_text(spark, folder):
    path = _out(spark, "triplets")
    TX.write_triplets_text(_prepare(spark, folder).tensor.entries, path, seed=1)
    return TX.read_triplets_text(spark, path)[0]


def store_tensor(spark, folder):
    path = _out(spark, "tensor")
    ST.write_tensor(_prepare(spark, folder).tensor, path)
    return ST.read_tensor(spark, path).entries


def store_dictionary(spark, folder):
    path = _out(spark, "dictionary")
    CSV.write_dictionary(_prepare(spark, folder).tensor.axes["med"].table, path)
    return CSV.read_dictionary(spark, path)


def store_events_csv(spark, folder):
    med_path, diag_path = _out(spark, "medication"), _out(spark, "diagnostic")
    med, diag = _events(spark, folder)
    med.write.csv(med_path, header=True)
    diag.write.csv(diag_path, header=True)
    med, diag = CSV.read_events(spark, med_path, diag_path)
    return VS.visit_pairs(med, diag)


def store_clinical_events(spark, folder):
    paths = [_out(spark, n) for n in ("medication", "lab", "diagnostic")]
    med, diag = _events(spark, folder)
    patient = F.col("subject_id").cast("string").alias("patient_id")
    med.select(patient, "date", F.col("med_name").alias("medicine")).write.csv(paths[0], header=True)
    proxy.lab(spark, folder).select(patient, "date", "test_name", "value").write.csv(paths[1], header=True)
    diag.select(patient, "date", "code").write.csv(paths[2], header=True)
    med, lab, diag = CSV.load_clinical_events(spark, *paths)
    back = F.col("patient_id").cast("bigint").alias("subject_id")
    return label_cohort(
        med.select(back, "date", F.col("medicine").alias("med_name")),
        lab.select(back, "date", "test_name", "value"),
        diag.select(back, "date", "code"), RULES)


def _debug_dump(name: str, schema: str) -> Query:
    def run(spark, folder):
        path = _out(spark, "debug")
        VS.visit_sides(*_events(spark, folder), debug_dir=path)
        return spark.read.csv(f"{path}/{name}", header=True, schema=schema)
    return run


def one_based_triplets(spark, folder):
    """The coordinates as readers that count from 1 expect them."""
    entries = _prepare(spark, folder).tensor.entries
    return entries.select(*[shift_index(a, 1) for a in AXES], "value")


def store_csv_table(spark, folder):
    path = _out(spark, "parts")
    proxy.table(spark, folder, "part").select("p_partkey", "p_brand", "p_size").write.csv(path, header=True)
    CSV.read_csv_table(spark, path, "stored_parts")
    return spark.sql("select p_brand, count(*) as n, max(cast(p_size as int)) as max_size from stored_parts group by p_brand")


def store_candidates(spark, folder):
    path = _out(spark, "candidates")
    _candidates(spark, folder)["med"].write.text(path)
    return _round(FT.medication_features(proxy.medication(spark, folder), CSV.read_candidate_set(spark, path)), 6, "value")


def store_profiles(spark, folder):
    p = _prepare(spark, folder)
    path = _out(spark, "profiles")
    both = C.profiles(p.counts, p.dims, p.priors, "med").unionByName(C.profiles(p.counts, p.dims, p.priors, "diag"))
    ST.write_profiles(both, path)
    return _round(ST.read_profiles(spark, path, axis="diag"), 9, "prob")


def store_factors(spark, folder):
    p = _prepare(spark, folder)
    path = _out(spark, "factors")
    _, factors = _stepped(spark, p)
    ST.write_factors(factors.long(), path)
    return _round(ST.read_factors(spark, path, "med"), 9, "value")


QUERIES: dict[str, Query] = {
    "relative_day": relative_days,
    "asof_visit": asof_visit,
    "asof_visit_bucket": _asof_visit("bucket"),
    "asof_visit_expand": _asof_visit("expand"),
    "visits": visits,
    "visit_pairs": visit_pairs,
    "axis_patient": _axis("subject_id"),
    "axis_code": _axis("code"),
    "axis_item": _axis("med_name"),
    "tensor_bag": _tensor("bag"),
    "tensor_binary": _tensor("binary"),
    "tensor_dims": tensor_dims,
    "decode_triplets": decode_triplets,
    "triplet_columns": triplet_columns,
    "table_names": table_names,
    "binarize": binarized,
    "diag_features": _one_feature("diag", False),
    "med_features": _one_feature("med", False),
    "lab_features": _one_feature("lab", False),
    "diag_features_filtered": _one_feature("diag", True),
    "med_features_filtered": _one_feature("med", True),
    "lab_features_filtered": _one_feature("lab", True),
    "features_union": features_union,
    "feature_matrix": feature_matrix,
    "feature_vectors": feature_vectors,
    "scaled_features": scaled_features,
    "scaled_vectors": scaled_vectors,
    "cohort_labels": cohort_labels,
    "kmeans_assign": kmeans_assign,
    "kmeans_step": kmeans_step,
    "kmeans_lloyd": kmeans_lloyd,
    "purity": cluster_purity,
    "vector_mean": vector_mean,
    "diag_cov": diag_cov,
    "gaussian_logpdf": gaussian_logpdf,
    "gmm_resp": gmm_resp,
    "argmax_component": argmax,
    "gmm_step": gmm_step,
    "gaussian_logpdf_full": _logpdf_full(False),
    "gaussian_logpdf_singular": _logpdf_full(True),
    "gmm_step_full": _step_full(False),
    "gmm_step_singular": _step_full(True),
    "gmm_fit_full": gmm_fit_full,
    "gmm_init": gmm_init,
    "gmm_fit_diagonal": gmm_fit_diagonal,
    "kmeans_fit": kmeans_fit,
    "gmm_fit": gmm_fit,
    "compare_clusterings": clusterings,
    "init_assignments": init_assignments,
    "component_counts": component_counts,
    "component_weights": component_weights,
    "component_posterior": component_posterior,
    "draw_category": draw_category,
    "frozen_sweep": frozen_sweep,
    "blocked_sweep": _sweep("blocked"),
    "compact_components": compacted,
    "apply_deltas": applied_deltas,
    "profiles_med": _profile("med"),
    "profiles_diag": _profile("diag"),
    "profiles_patient": _profile("patient"),
    "profiles_patient_sparse": profiles_patient_sparse,
    "component_shares": component_shares,
    "top_items": top_items,
    "score_triplets": score_triplets,
    "log_joint": log_joint,
    "dirichlet_draws": dirichlet_draws,
    "fit_phenotypes": fit_phenotypes,
    "fit_history": fit_history,
    "ncp_step": ncp_step,
    "ncp_reconstruct": ncp_reconstruct,
    "ncp_mask": ncp_mask,
    "ncp_fit": ncp_fit,
    "ncp_matrix_mask": ncp_matrix_mask,
    "top_factor_items": top_factor_items,
    "store_triplets_text": store_triplets_text,
    "store_tensor": store_tensor,
    "store_dictionary": store_dictionary,
    "store_events_csv": store_events_csv,
    "store_clinical_events": store_clinical_events,
    "debug_diagnoses": _debug_dump("diag", "subject_id bigint, code string, date int"),
    "debug_medications": _debug_dump("med", "subject_id bigint, med_name string, date int, assignment int"),
    "one_based_triplets": one_based_triplets,
    "store_csv_table": store_csv_table,
    "store_candidates": store_candidates,
    "store_profiles": store_profiles,
    "store_factors": store_factors,
}
