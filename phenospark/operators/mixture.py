"""Gaussian mixtures: start, densities, memberships, one EM step, and full fits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.sql import DataFrame, functions as F

from phenospark.functions.rand import np_uniform
from phenospark.operators.order import rows_at
from phenospark.operators.vectors import block, collect_matrix, dimension_stats, lists
from phenospark.runtime import materialize

# Machine epsilon as the membership guard, and vectors drawn per component at start.
EPSILON = 2.220446049250313e-16
SAMPLES_PER_COMPONENT = 5


@dataclass(frozen=True)
class Mixture:
    """Weights (k), means (k x d) and covariances (k x d x d, or k x d when diagonal)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    @cached_property
    def axes(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Variances and directions of each component, decomposed once per model."""
        return [(c, None) if c.ndim == 1 else tuple(np.linalg.eigh(c)) for c in self.covariances]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log-density of each row of ``x`` under each component.

        A singular covariance uses its pseudo-inverse and pseudo-determinant: directions whose
        eigenvalue does not exceed epsilon * dimensions * largest eigenvalue are left out.
        """
        out = np.empty((len(x), len(self.weights)))
        d = self.means.shape[1]
        for j, (mean, (values, vectors)) in enumerate(zip(self.means, self.axes)):
            delta = x - mean if vectors is None else (x - mean) @ vectors
            used = values > EPSILON * d * values.max()
            if not used.any():
                raise ValueError("covariance has no non-zero direction")
            scaled = delta[:, used] ** 2 / values[used]
            out[:, j] = -0.5 * (d * np.log(2.0 * np.pi) + np.log(values[used]).sum() + scaled.sum(axis=1))
        return out

    def scaled_memberships(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memberships, and the log of each row's total weight with the guard epsilon per component.

        Both are taken relative to the row's largest term, so no density overflows or vanishes.
        """
        with np.errstate(divide="ignore"):
            logs = np.log(self.weights) + self.log_density(x)
        top = np.maximum(logs.max(axis=1, keepdims=True), np.log(EPSILON))
        p = np.exp(logs - top) + np.exp(np.log(EPSILON) - top)
        total = p.sum(axis=1, keepdims=True)
        return p / total, (np.log(total) + top)[:, 0]

    def memberships(self, x: np.ndarray) -> np.ndarray:
        return self.scaled_memberships(x)[0]


def gmm_responsibilities(df: DataFrame, column: str, model: Mixture, out: str = "resp") -> DataFrame:
    """Membership of each vector in every component, as an array."""
    model.axes  # decomposed here, not in every task

    @F.arrow_udf("array<double>")
    def memberships(column: pa.Array) -> pa.Array:
        x = block(column)
        return lists(model.memberships(x)) if len(x) else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(out, memberships(column))


def gaussian_logpdf(df: DataFrame, column: str, model: Mixture, out: str = "logpdf") -> DataFrame:
    """Log-density of each vector under every component, as an array."""
    model.axes  # decomposed here, not in every task

    @F.arrow_udf("array<double>")
    def density(column: pa.Array) -> pa.Array:
        x = block(column)
        return lists(model.log_density(x)) if len(x) else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(out, density(column))


def gmm_step(df: DataFrame, column: str, model: Mixture) -> DataFrame:
    """One EM step with diagonal covariance: (k, dim, weight, mean, var, log_likelihood).

    Tasks add up memberships, and first and second moments about the old means (which keeps the
    variance from cancelling); k x d rows per task reach the shuffle.
    """
    k, d = model.means.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, first, second = np.zeros(k), np.zeros((k, d)), np.zeros((k, d))
        n, loglik = 0, 0.0
        for batch in batches:
            x = block(batch.column(0))
            if not len(x):
                continue
            r, logs = model.scaled_memberships(x)
            loglik += float(logs.sum())
            n += len(x)
            mass += r.sum(axis=0)
            for j in range(k):
                delta = x - model.means[j]
                first[j] += r[:, j] @ delta
                second[j] += r[:, j] @ delta**2
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(k, dtype=np.int32), d)),
            pa.array(np.tile(np.arange(d, dtype=np.int32), k)),
            pa.array(np.full(k * d, float(n))),
            pa.array(np.full(k * d, loglik)),
            pa.array(np.repeat(mass, d)),
            pa.array(first.ravel()),
            pa.array(second.ravel()),
        ], names=["k", "dim", "n", "ll", "mass", "s1", "s2"])

    parts = df.select(column).mapInArrow(
        partial, "k int, dim int, n double, ll double, mass double, s1 double, s2 double")
    sums = parts.groupBy("k", "dim").agg(*[F.sum(c).alias(c) for c in ("n", "ll", "mass", "s1", "s2")])
    old = F.element_at(F.lit(model.means.ravel().tolist()), F.col("k") * d + F.col("dim") + 1)
    shift = F.col("s1") / F.col("mass")
    return sums.select(
        "k", "dim",
        (F.col("mass") / F.col("n")).alias("weight"),
        (old + shift).alias("mean"),
        (F.col("s2") / F.col("mass") - shift * shift).alias("var"),
        F.col("ll").alias("log_likelihood"),
    )


def _moments(df: DataFrame, columns: list[str], means: np.ndarray, memberships) -> DataFrame:
    """Weighted second moments about given centres: (k, dim, other, n, ll, mass, s1, t1, s2).

    ``memberships`` maps a batch and its vectors to the weight of each vector in every component
    and to what each adds to the log-likelihood. Tasks add up one matrix per component; Spark adds
    the cells of their upper halves by cell, so no task or driver gathers the matrices of all.
    """
    k, d = means.shape
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, first, second = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        n, loglik = 0, 0.0
        for batch in batches:
            x = block(batch.column(0))
            if not len(x):
                continue
            r, logs = memberships(batch, x)
            loglik += float(logs.sum())
            n += len(x)
            mass += r.sum(axis=0)
            for j in range(k):
                delta = x - means[j]
                weighted = r[:, j, None] * delta
                first[j] += weighted.sum(axis=0)
                second[j] += weighted.T @ delta
        if n:
            cells = len(upper[0])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(k, dtype=np.int32), cells)),
                pa.array(np.tile(upper[0].astype(np.int32), k)),
                pa.array(np.tile(upper[1].astype(np.int32), k)),
                pa.array(np.full(k * cells, float(n))),
                pa.array(np.full(k * cells, loglik)),
                pa.array(np.repeat(mass, cells)),
                pa.array(first[:, upper[0]].ravel()),
                pa.array(first[:, upper[1]].ravel()),
                pa.array(second[:, upper[0], upper[1]].ravel()),
            ], names=["k", "dim", "other", *sums])

    sums = ["n", "ll", "mass", "s1", "t1", "s2"]
    schema = "k int, dim int, other int, " + ", ".join(f"{c} double" for c in sums)
    parts = df.select(*columns).mapInArrow(partial, schema)
    return parts.groupBy("k", "dim", "other").agg(*[F.sum(c).alias(c) for c in sums])


def _from_moments(sums: DataFrame, means: np.ndarray) -> DataFrame:
    """(k, dim, other, weight, mean, cov, log_likelihood) for dim <= other; ``mean`` is that of dim."""
    old = F.element_at(F.lit(means.ravel().tolist()), F.col("k") * means.shape[1] + F.col("dim") + 1)
    shift, across = F.col("s1") / F.col("mass"), F.col("t1") / F.col("mass")
    return sums.select(
        "k", "dim", "other",
        (F.col("mass") / F.col("n")).alias("weight"),
        (old + shift).alias("mean"),
        (F.col("s2") / F.col("mass") - shift * across).alias("cov"),
        F.col("ll").alias("log_likelihood"),
    )


def gmm_step_full(df: DataFrame, column: str, model: Mixture) -> DataFrame:
    """One EM step with full covariance: (k, dim, other, weight, mean, cov, log_likelihood).

    ``cov`` belongs to dim <= other. Moments are taken about the old means, which keeps covariances
    from cancelling. Singular covariances are allowed (see :meth:`Mixture.log_density`).
    """
    model.axes  # decomposed here, not in every task
    sums = _moments(df, [column], model.means, lambda batch, x: model.scaled_memberships(x))
    return _from_moments(sums, model.means)


def group_mixture(df: DataFrame, column: str, group: str, k: int) -> Mixture:
    """Weight, mean and full covariance of each of k groups of vectors, numbered 0..k-1 by an integer
    column; a pass for the means and one for the moments about them."""
    means = collect_matrix(dimension_stats(df, column, [group]), group, "mean")
    if len(means) != k:
        raise ValueError(f"{len(means)} groups hold vectors, not {k}")

    def hard(batch: pa.RecordBatch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (batch.column(1).to_numpy()[:, None] == np.arange(k)).astype(np.float64), np.zeros(len(x))

    return full_mixture(_from_moments(_moments(df, [column, group], means, hard), means))


def full_mixture(step: DataFrame) -> Mixture:
    """The parameters of a full-covariance step's small result."""
    rows = step.collect()
    k, d = (1 + max(r[c] for r in rows) for c in ("k", "dim"))
    weights, means, cov = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for r in rows:
        weights[r["k"]], means[r["k"], r["dim"]] = r["weight"], r["mean"]
        cov[r["k"], r["dim"], r["other"]] = cov[r["k"], r["other"], r["dim"]] = r["cov"]
    return Mixture(weights, means, cov)


def gmm_fit_full(
    df: DataFrame, column: str, start: Mixture, tol: float = 0.01, max_iter: int = 100
) -> tuple[Mixture, list[float]]:
    """Full-covariance EM steps until the log-likelihood gains less than ``tol``; also the value at
    each step. Covariances may become singular: their pseudo-inverse is used from then on."""
    model, history = start, []
    for _ in range(max_iter):
        step = materialize(gmm_step_full(df, column, model), "step")
        history.append(step.agg(F.first("log_likelihood")).first()[0])
        if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
            break
        model = full_mixture(step)
    return model, history


def mixture_from_step(step: DataFrame) -> Mixture:
    """The parameters of a step's small result."""
    weights = collect_matrix(step, "k", "weight")[:, 0]
    return Mixture(weights, collect_matrix(step, "k", "mean"), collect_matrix(step, "k", "var"))


def seed_components(df: DataFrame, order: str, column: str, k: int, seed: int, samples: int = SAMPLES_PER_COMPONENT) -> DataFrame:
    """k * samples rows drawn with replacement: (component, draw, column).

    The driver only draws row numbers; :func:`rows_at` finds the rows without ordering all of them.
    ``order`` is a column that is unique per row; rows where it is null are not drawn.
    """
    n = df.where(F.col(order).isNotNull()).count()
    draws = [(i // samples, i % samples, int(u * n)) for i, u in enumerate(np_uniform(np.arange(k * samples), seed))]
    wanted = df.sparkSession.createDataFrame(draws, "component int, draw int, _row bigint")
    keys = rows_at(df, order, sorted({d[2] for d in draws}), n).join(F.broadcast(wanted), "_row")
    return df.select(order, column).join(F.broadcast(keys), order).select("component", "draw", column)


def gmm_init(df: DataFrame, order: str, column: str, k: int = 2, seed: int = 1) -> Mixture:
    """Uniform weights; each component has the mean and diagonal variance of its own five draws."""
    stats = dimension_stats(seed_components(df, order, column, k, seed), column, ["component"])
    return Mixture(np.full(k, 1.0 / k), collect_matrix(stats, "component", "mean"), collect_matrix(stats, "component", "var"))


def gmm_fit_diagonal(
    df: DataFrame, column: str, start: Mixture, tol: float = 0.01, max_iter: int = 100
) -> tuple[Mixture, list[float]]:
    """EM steps until the log-likelihood gains less than ``tol``; also the value at each step."""
    model, history = start, []
    for _ in range(max_iter):
        rows = gmm_step(df, column, model).collect()
        history.append(rows[0]["log_likelihood"])
        if len(history) > 1 and abs(history[-1] - history[-2]) < tol:
            break
        k, d = model.means.shape
        weights, means, variances = np.zeros(k), np.zeros((k, d)), np.zeros((k, d))
        for r in rows:
            weights[r["k"]] = r["weight"]
            means[r["k"], r["dim"]] = r["mean"]
            variances[r["k"], r["dim"]] = max(r["var"], EPSILON)
        model = Mixture(weights, means, variances)
    return model, history


def gmm_fit(
    vectors: DataFrame, column: str = "features", k: int = 2, tol: float = 0.01, max_iter: int = 100, seed: int = 1
) -> GaussianMixtureModel:
    """Spark's own full-covariance mixture."""
    return GaussianMixture(
        featuresCol=column, predictionCol="cluster", probabilityCol="probability",
        k=k, tol=tol, maxIter=max_iter, seed=seed,
    ).fit(vectors)
