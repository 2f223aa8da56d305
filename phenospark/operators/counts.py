"""Component counts, priors, and what follows from them: profiles, shares, scores, joint density."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phenospark.functions.rand import np_log_gamma_draws, np_uniform, uniform
from phenospark.functions.special import lgamma
from phenospark.operators.joins import lookup
from phenospark.operators.vectors import block, lists
from phenospark.runtime import materialize
from phenospark.schema import AXES

# Concentration, prior mass per axis, and components at the start.
ALPHA = 0.5
GAMMA_BASE = 50.0
K0 = 10
# Fixed value: finite number of components in the symmetric form of the prior.
K_MAX = 64


@dataclass(frozen=True)
class Priors:
    """Concentration of new components and the symmetric Dirichlet parameter of each axis."""

    alpha: float
    gamma: dict[str, float]

    @classmethod
    def from_dims(cls, dims: dict[str, int], alpha: float = ALPHA, base: float = GAMMA_BASE) -> Priors:
        return cls(alpha, {a: base / n for a, n in dims.items()})


def stick_breaking_weights(alpha: float, k: int, seed: int = 1) -> np.ndarray:
    """The first k component weights of the prior: shares b_1, b_2 (1 - b_1), ... with
    b ~ Beta(1, alpha). A handful of numbers, for making test data."""
    b = 1.0 - np_uniform(np.arange(k), seed) ** (1.0 / alpha)
    return b * np.concatenate([[1.0], np.cumprod(1.0 - b)[:-1]])


def init_assignments(records: DataFrame, seed: int = 1, k0: int = K0) -> DataFrame:
    """A uniform component 0..k0-1 for each record, fixed by (seed, rec_id)."""
    k = F.floor(uniform("rec_id", seed, 0) * F.lit(float(k0))).cast("bigint")
    return records.withColumn("k", k)


def component_counts(assigned: DataFrame) -> DataFrame:
    """(axis, k, idx, cnt) in one pass: records per component ('all', idx null), and per component
    and value of each axis. Zero counts are not stored."""
    k = F.col("k")
    sets = assigned.groupingSets([[k], *[[k, F.col(a)] for a in AXES]], k, *AXES).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.grouping(a).alias(f"_no_{a}") for a in AXES])
    axis = F.lit("all")
    for a in AXES:
        axis = F.when(F.col(f"_no_{a}") == 0, F.lit(a)).otherwise(axis)
    return sets.select(axis.alias("axis"), "k", F.coalesce(*AXES).alias("idx"), "cnt")


def apply_deltas(counts: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Counts after taking records out of their components and putting records in."""
    change = component_counts(removed).withColumn("cnt", -F.col("cnt")).unionByName(component_counts(added))
    both = counts.unionByName(change)
    return both.groupBy("axis", "k", "idx").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def live_totals(counts: DataFrame) -> list[tuple[int, int]]:
    """(component, records) of the components in use, by id."""
    rows = counts.where("axis = 'all'").select("k", "cnt").collect()
    return sorted((r["k"], r["cnt"]) for r in rows)


def count_arrays(counts: DataFrame, axis: str, live: list[int]) -> DataFrame:
    """One row per value of an axis with its counts in the given components, as an array.

    A value has at most one count per component, so the list it is built from is that short.
    """
    rows = counts.where(F.col("axis") == axis).groupBy(F.col("idx").alias(axis)).agg(
        F.map_from_entries(F.collect_list(F.struct("k", "cnt"))).alias("_m"))
    ids = F.lit(live).cast("array<bigint>")
    array = F.transform(ids, lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0)).cast("double"))
    return rows.select(axis, array.alias(f"_{axis}"))


def attach_counts(records: DataFrame, counts: DataFrame, dims: dict[str, int], live: list[int], limit: int | None = None) -> DataFrame:
    """Each record with the count array of its patient, diagnosis and medication: a record stays
    one row, whatever the number of components. A value without counts gets zeros."""
    zeros = F.lit([0.0] * len(live))
    for axis in AXES:
        arrays = count_arrays(counts, axis, live)
        records = lookup(records, arrays, [axis], "left", rows=dims[axis], row_bytes=8 * len(live) + 48, limit=limit)
        records = records.withColumn(f"_{axis}", F.coalesce(f"_{axis}", zeros))
    return records


def _array_columns() -> list[str]:
    return [f"_{a}" for a in AXES]


def weights_block(
    k: np.ndarray, cells: dict[str, np.ndarray], totals: list[tuple[int, int]], dims: dict[str, int], priors: Priors
) -> np.ndarray:
    """Weights for a block of records (rows): each live component, then a new one. The record's
    own count is taken out of its component."""
    live = np.array([c for c, _ in totals])
    own = (k[:, None] == live).astype(np.float64)
    rest = np.array([float(n) for _, n in totals]) - own
    w = rest.copy()
    for axis in ("patient", "med", "diag"):
        g = priors.gamma[axis]
        w *= (cells[axis] - own + g) / (rest + dims[axis] * g)
    return np.column_stack([w, np.full(len(w), new_weight(dims, priors))])


def weight_array(totals: list[tuple[int, int]], dims: dict[str, int], priors: Priors) -> Column:
    """The weights of a record with attached counts, as an array column."""
    @F.arrow_udf("array<double>")
    def weights(k: pa.Array, patient: pa.Array, diag: pa.Array, med: pa.Array) -> pa.Array:
        cells = dict(zip(AXES, map(block, (patient, diag, med))))
        return lists(weights_block(k.to_numpy(), cells, totals, dims, priors)) if len(k) else lists(np.empty(0))

    return weights("k", *_array_columns())


def new_weight(dims: dict[str, int], priors: Priors) -> float:
    """Weight of a component not yet in use; the same for every record."""
    return priors.alpha / math.prod(dims[a] for a in AXES)


def component_weights(
    assigned: DataFrame, counts: DataFrame, dims: dict[str, int], priors: Priors, normalise: bool = False
) -> DataFrame:
    """(rec_id, k, weight) for every record and live component, and k = -1 for a new component.

    ``normalise`` gives the posterior probability ``prob`` instead.
    """
    totals = live_totals(counts)
    rows = attach_counts(assigned, counts, dims, [k for k, _ in totals])
    rows = rows.select("rec_id", weight_array(totals, dims, priors).alias("_w"))
    name = "weight"
    if normalise:
        name = "prob"
        total = F.aggregate("_w", F.lit(0.0), lambda a, b: a + b)
        rows = rows.withColumn("_t", total).select("rec_id", F.transform("_w", lambda x: x / F.col("_t")).alias("_w"))
    ids = F.lit([k for k, _ in totals] + [-1]).cast("array<bigint>")
    return rows.select("rec_id", F.posexplode("_w").alias("_i", name)).select(
        "rec_id", ids[F.col("_i")].alias("k"), name)


def draw_category(weights: Column | str, u: Column) -> Column:
    """First 0-based position whose running weight reaches ``u`` times the total."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    # the goal travels in the accumulator, so it is worked out once per record
    start = F.struct(
        F.lit(0.0).alias("run"), F.lit(0).alias("i"), F.lit(-1).alias("at"), (u * total).alias("goal"))

    def step(s: Column, w: Column) -> Column:
        run = s["run"] + w
        hit = (s["at"] < 0) & (run >= s["goal"])
        at = F.when(hit, s["i"]).otherwise(s["at"])
        return F.struct(run.alias("run"), (s["i"] + 1).alias("i"), at.alias("at"), s["goal"].alias("goal"))

    return F.aggregate(weights, start, step, lambda s: s["at"])


def profiles(counts: DataFrame, dims: dict[str, int], priors: Priors, axis: str) -> DataFrame:
    """(axis, k, idx, prob) for every value of the axis and every live component."""
    totals = live_totals(counts)
    g, n = priors.gamma[axis], dims[axis]
    ids = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(c).alias("total")) for k, c in totals])
    grid = counts.sparkSession.range(n).select(F.col("id").alias("idx"), F.explode(ids).alias("_c")).select(
        "idx", "_c.k", "_c.total")
    found = counts.where(F.col("axis") == axis).select("k", "idx", "cnt")
    prob = (F.coalesce("cnt", F.lit(0)) + F.lit(g)) / (F.col("total") + F.lit(n * g))
    return grid.join(found, ["k", "idx"], "left").select(F.lit(axis).alias("axis"), "k", "idx", prob.alias("prob"))


def sparse_profiles(counts: DataFrame, dims: dict[str, int], priors: Priors, axis: str) -> DataFrame:
    """(axis, k, idx, prob) of the values that were counted with a component, and one row per live
    component without ``idx``: the probability of each of all its other values.

    As long as the stored counts, where :func:`profiles` has values x components rows.
    """
    g, n = priors.gamma[axis], dims[axis]
    totals = counts.where("axis = 'all'").select("k", F.col("cnt").alias("total"))
    found = counts.where(F.col("axis") == axis).select("k", "idx", "cnt")
    joined = lookup(found, totals, ["k"], rows=totals.count())
    rest = totals.select("k", F.lit(None).cast("bigint").alias("idx"), F.lit(0).cast("bigint").alias("cnt"), "total")
    prob = (F.col("cnt") + F.lit(g)) / (F.col("total") + F.lit(n * g))
    return joined.select("k", "idx", "cnt", "total").unionByName(rest).select(F.lit(axis).alias("axis"), "k", "idx", prob.alias("prob"))


def profile_of(profile: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells ``(k, idx, ...)`` with their probability in a sparse profile of one axis."""
    rest = profile.where(F.col("idx").isNull()).select("k", F.col("prob").alias("_rest"))
    held = profile.where(F.col("idx").isNotNull()).select("k", "idx", "prob")
    joined = lookup(cells, rest, ["k"], rows=rest.count()).join(held, ["k", "idx"], "left")
    return joined.withColumn("prob", F.coalesce("prob", "_rest")).drop("_rest")


def component_shares(counts: DataFrame) -> DataFrame:
    """(k, cnt, share): each live component's part of all records."""
    totals = counts.where("axis = 'all'").select("k", "cnt")
    n = totals.agg(F.sum("cnt")).scalar()
    return totals.select("k", "cnt", (F.col("cnt") / n).alias("share"))


def top_items(profile: DataFrame, n: int = 10, by: tuple[str, ...] = ("axis", "k"), value: str = "prob", idx: str = "idx") -> DataFrame:
    """The n entries of largest value per group, with their rank; ties go to the higher index.

    Spark cuts each task's groups to n rows before the shuffle, so a long axis is not gathered.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(value), F.desc(idx))
    return profile.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def score_triplets(records: DataFrame, counts: DataFrame, dims: dict[str, int], priors: Priors) -> DataFrame:
    """Records with ``score``, their mixture likelihood: the sum over components of share times
    the three profile probabilities."""
    totals = live_totals(counts)
    rows = attach_counts(records, counts, dims, [k for k, _ in totals])
    size = np.array([float(c) for _, c in totals])
    share = size / size.sum()

    @F.arrow_udf("double")
    def likelihood(patient: pa.Array, diag: pa.Array, med: pa.Array) -> pa.Array:
        p = np.tile(share, (len(patient), 1))
        for axis, column in zip(AXES, (patient, diag, med)):
            if len(column):
                g = priors.gamma[axis]
                p *= (block(column) + g) / (size + dims[axis] * g)
        return pa.array(p.sum(axis=1))

    return rows.withColumn("score", likelihood(*_array_columns())).drop(*_array_columns())


def log_joint(counts: DataFrame, dims: dict[str, int], priors: Priors, r: int | None = None) -> DataFrame:
    """One row (n_records, n_components, log_joint): log-probability of assignments and records
    with weights and profiles integrated out, for the finite form with ``r`` components.

    Cells without records contribute nothing, so only stored counts are visited. By default ``r`` is
    that of a fit: 64, doubled until the components in use fit. A given ``r`` below their number is
    an error.
    """
    alpha = priors.alpha
    if r is None:
        r, live = K_MAX, counts.where("axis = 'all'").count()
        while r < live:
            r *= 2
    value = F.lit(0.0)
    for axis in AXES:
        g = priors.gamma[axis]
        value = F.when(F.col("axis") == axis, lgamma(F.col("cnt") + F.lit(g)) - F.lit(math.lgamma(g))).otherwise(value)
    per_component = lgamma(F.col("cnt") + F.lit(alpha / r)) - F.lit(math.lgamma(alpha / r))
    for axis in AXES:
        mass = dims[axis] * priors.gamma[axis]
        per_component = per_component + F.lit(math.lgamma(mass)) - lgamma(F.col("cnt") + F.lit(mass))
    value = F.when(F.col("axis") == "all", per_component).otherwise(value)
    is_all = F.col("axis") == "all"
    n = F.sum(F.when(is_all, F.col("cnt")))
    used = F.count(F.when(is_all, F.lit(1)))
    value = F.lit(math.lgamma(alpha)) - lgamma(n + F.lit(alpha)) + F.sum(value)
    fits = F.when(used <= r, value).otherwise(F.raise_error(F.lit(f"more components in use than r = {r}")).cast("double"))
    return counts.agg(n.alias("n_records"), used.alias("n_components"), fits.alias("log_joint"))


def dirichlet_draws(counts: DataFrame, dims: dict[str, int], priors: Priors, axis: str, seed: int, sweep: int = 0) -> DataFrame:
    """(axis, k, idx, prob): one posterior draw of each live component's profile.

    Each cell draws its own gamma number from (seed, sweep, cell), in logs; the sum per component
    is the normaliser. With empty counts of a component the draw is from the prior.
    """
    code = AXES.index(axis) + 1
    n, g = dims[axis], priors.gamma[axis]

    @F.pandas_udf("double")
    def log_gamma(shape: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series(np_log_gamma_draws(shape.to_numpy(), cell.to_numpy(), seed, sweep, code))

    base = profiles(counts, dims, priors, axis).select("axis", "k", "idx")
    found = counts.where(F.col("axis") == axis).select("k", "idx", "cnt")
    cells = materialize(base.join(found, ["k", "idx"], "left").select(
        "axis", "k", "idx",
        log_gamma(F.coalesce("cnt", F.lit(0)) + F.lit(g), F.col("k") * F.lit(n) + F.col("idx")).alias("_lg")), "gammas")
    top = cells.groupBy("k").agg(F.max("_lg").alias("_top"))
    live = len(live_totals(counts))
    shifted = lookup(cells, top, ["k"], rows=live).withColumn("_e", F.exp(F.col("_lg") - F.col("_top")))
    norm = shifted.groupBy("k").agg(F.sum("_e").alias("_sum"))
    return lookup(shifted, norm, ["k"], rows=live).select(
        "axis", "k", "idx", (F.col("_e") / F.col("_sum")).alias("prob"))
