"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``max_sample`` vectors by hash of the id) the exact neighbour graph is cut
into parts of equal size by recursive spectral bisection. A small softmax network learns, from a
vector, in which parts its neighbours lie. Every row of the table is then filed under its most
probable part, and a query visits its most probable parts; how many is measured on the sample, as
the least number that finds ``target`` of the true neighbours there. All rows of the visited parts
are ranked by the exact measure, so the part only decides what is looked at.

Parts with many rows (a third of all vectors may be equal) are cut into hashed blocks, each ranked
by itself; block results are merged by a second top-k, so no task holds a whole part. Equal
vectors get equal scores, and ties go to the smaller id.

Defined cases: vectors that are null, all zero, of another length than most of the sample, or with
a null or non-finite component take no part; repeated rows are ranked as rows; fewer than k
candidates give all of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from phenospark.llm.common import prepare
from phenospark.runtime import materialize

BLOCK_ROWS = 8192
QUERY_ROWS = 256


@dataclass(frozen=True)
class Router:
    """One hidden layer from a vector to part probabilities, and how many parts to visit."""

    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) @ self.w1 + self.b1) @ self.w2 + self.b2


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Exact k nearest by inner product among the sample, itself left out, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        scores = x[a : a + 1024] @ x.T
        scores[np.arange(len(scores)), a + np.arange(len(scores))] = -np.inf
        out[a : a + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def bisect(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cut the neighbour graph into ``parts`` (a power of two) of equal size.

    Each level splits every part at the median of a smoothed random vector: repeated averaging over
    the edges inside the part, orthogonal to the constant, tends to the slowest cut direction.
    """
    n, k = graph.shape
    part = np.zeros(n, np.int64)
    src, dst = np.repeat(np.arange(n), k), graph.ravel()
    while (count := part.max() + 1 if n else parts) < parts:
        inner = part[src] == part[dst]
        s, d = src[inner], dst[inner]
        degree = np.bincount(s, minlength=n) + np.bincount(d, minlength=n) + 1.0
        sizes = np.bincount(part, minlength=count)
        v = rng.standard_normal(n)
        for _ in range(60):
            v = (v + np.bincount(s, v[d], n) + np.bincount(d, v[s], n)) / degree
            v -= (np.bincount(part, v * degree, count) / np.bincount(part, degree, count))[part]
            v /= np.sqrt(np.bincount(part, v * v, count) / sizes)[part] + 1e-30
        order = np.lexsort((v, part))
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        half = np.empty(n, np.int64)
        half[order] = place >= np.repeat(sizes // 2, sizes)
        part = 2 * part + half
    return part


def train_router(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, target: float, rng, hidden: int = 128, epochs: int = 60) -> Router:
    """Softmax network on the share of a vector's neighbours (and itself) in each part."""
    n, dim = x.shape
    soft = np.zeros((n, parts))
    np.add.at(soft, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    soft[np.arange(n), part] += 2.0
    soft /= soft.sum(axis=1, keepdims=True)
    mean = x.mean(axis=0)
    scale = 1.0 / (np.sqrt(((x - mean) ** 2).sum(axis=1).mean()) + 1e-12)
    p = [rng.standard_normal((dim, hidden)) * 2 * scale, np.zeros(hidden), rng.standard_normal((hidden, parts)) * hidden**-0.5, np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(n), max(n // 256, 1)):
            z, t = x[at] - mean, t + 1
            h = np.tanh(z @ p[0] + p[1])
            y = h @ p[2] + p[3]
            y = np.exp(y - y.max(axis=1, keepdims=True))
            e = (y / y.sum(axis=1, keepdims=True) - soft[at]) / len(at)
            back = (e @ p[2].T) * (1 - h * h)
            for i, g in enumerate((z.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                step = 0.01 * (scale if i == 0 else 1.0)
                p[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-12)
    router = Router(mean, *p, probes=parts)
    order = np.argsort(-router.logits(x), axis=1)
    home = order[:, 0]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(n, 0), axis=1)
    needed = np.take_along_axis(rank, home[graph], axis=1).ravel()
    reach = np.cumsum(np.bincount(needed, minlength=parts)) / len(needed)
    return Router(mean, *p, probes=int(np.searchsorted(reach, target) + 1))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, in double precision."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(good & F.col(key).isNotNull())


def fit_router(rows: DataFrame, n_rows: int, max_sample: int = 8192, per_part: int = 1024, max_parts: int = 16, k: int = 20, target: float = 0.97, seed: int = 7) -> Router | None:
    """Fit on at most ``max_sample`` rows, the ones of least hash; None for an empty table."""
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(max_sample).toPandas()
    if picked.empty:
        return None
    dims = picked.v.map(len)
    dim = int(dims.mode().min())
    x = np.stack(picked.v[dims == dim].to_list())
    rng = np.random.default_rng(seed)
    parts = 1
    while parts < max_parts and parts * per_part < n_rows and parts * 64 < len(x):
        parts *= 2
    if parts == 1 or len(x) <= k:
        one = np.zeros(1)
        return Router(np.zeros(dim), np.zeros((dim, 1)), one, np.zeros((1, 1)), one, 1)
    graph = neighbours(x, k)
    return train_router(x, bisect(graph, parts, rng), graph, parts, target, rng)


def _routed(router, most: int):
    """(id, v) to (part, id, v), each row once for each of its ``most`` most probable parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(router.value.mean)
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            batch = batch.filter(pa.array(lengths == dim))
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            logits = router.value.logits(x)
            order = np.argsort(-logits, axis=1, kind="stable")[:, : min(most, logits.shape[1])]
            at = pa.array(np.repeat(np.arange(len(x)), order.shape[1]))
            parts = pa.array(order.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([parts, batch.column("id").take(at), batch.column("v").take(at)], ["part", "id", "v"])

    return run


def _nearest(k: int):
    """Rank one block of rows for the queries that visit it, a few queries at a time."""

    def rank(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and rows.num_rows:
            ids, qids = rows.column("id").to_numpy(), queries.column("id").to_numpy()
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            x, q = matrix(rows), matrix(queries)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for a in range(0, len(q), QUERY_ROWS):
                rough = q[a : a + QUERY_ROWS] @ x.T
                for i, line in enumerate(rough):
                    # rows whose rough score could be among the k best, then the exact sum for those
                    line[ids == qids[a + i]] = -np.inf
                    bound = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                    near = np.flatnonzero((line >= bound - 1e-9 * (1 + abs(bound))) & (line > -np.inf)) if bound > -np.inf else np.flatnonzero(line > -np.inf)
                    exact = np.add.reduce(x[near] * q[a + i], axis=1)
                    best = near[np.lexsort((ids[near], -exact))[:k]]
                    out[0].append(np.full(len(best), qids[a + i]))
                    out[1].append(ids[best])
                    out[2].append(np.add.reduce(x[best] * q[a + i], axis=1))
        joined = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "id", "score"), joined)))

    return rank


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", max_sample: int = 8192) -> DataFrame:
    """The k nearest found of every query: query_id, rank (from 1), key, score. Queries leave their own id out."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = materialize(usable(vectors, key, vector), "vectors")
    router = fit_router(rows, rows.count(), max_sample, k=k)
    out = f"query_id bigint, rank int, {key} bigint, score double"
    if router is None:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(router)
    filed = materialize(rows.mapInArrow(_routed(shared, 1), "part int, id bigint, v array<double>"), "filed")
    asked = usable(queries, key, vector).mapInArrow(_routed(shared, router.probes), "part int, id bigint, v array<double>")
    # one number per part, at most max_parts of them
    sizes = {r.part: r["count"] for r in filed.groupBy("part").count().collect()}
    blocks = F.element_at(F.lit([max(1, -(-sizes.get(p, 0) // BLOCK_ROWS)) for p in range(max(sizes, default=0) + 1)]), F.col("part") + 1)
    known = asked.where(F.col("part").isin(*sizes)) if sizes else asked.limit(0)
    left = known.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = filed.withColumn("block", F.pmod(F.xxhash64("id", F.spark_partition_id()), blocks).cast("int"))
    groups = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    found = groups.applyInArrow(_nearest(k), "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", F.col("id").alias(key), "score")
