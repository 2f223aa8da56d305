"""Non-negative tensor factorisation by multiplicative updates, for any number of modes.

A factor matrix is a table ``(idx, f)`` with one array of R values per index. Absent cells of the
tensor count as zeros through R x R Gram matrices; they are never stored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phenospark.functions.rand import np_uniform
from phenospark.functions.scalars import binarize, rescale
from phenospark.operators.joins import Clustered, fits_broadcast, lookup
from phenospark.operators.vectors import block, lists
from phenospark.runtime import materialize

# Fixed value: rank of the factorisation.
RANK = 30
# keeps denominators away from zero
FLOOR = 1e-9
# a fit keeps its entries by the longest mode, if the other modes together have no more cells
DENSE_CELLS = 1 << 12
# updates of the longest mode that tasks repeat before they are written
REPLAY = 8
# most numbers that a task unpacks entries into at once
BLOCK_CELLS = 1 << 20


@dataclass(frozen=True)
class Factors:
    """One table per mode, the mode sizes, and the rank."""

    tables: dict[str, DataFrame]
    dims: dict[str, int]
    rank: int

    @property
    def modes(self) -> list[str]:
        return list(self.tables)

    def long(self) -> DataFrame:
        """(mode, idx, r, value)."""
        parts = [
            t.select(F.lit(m).alias("mode"), "idx", F.posexplode("f").alias("r", "value"))
            for m, t in self.tables.items()
        ]
        return reduce(DataFrame.unionByName, parts)


def initial_factors(spark, dims: dict[str, int], rank: int = RANK, seed: int = 1) -> Factors:
    """Uniform starting values fixed by (seed, mode, cell)."""
    def start(number: int) -> Column:
        @F.arrow_udf("array<double>")
        def cells(idx: pa.Array) -> pa.Array:
            cell = idx.to_numpy()[:, None] * rank + np.arange(rank)
            return lists(np_uniform(cell, seed, number))

        return cells("idx")

    tables = {
        mode: spark.range(n).select(F.col("id").alias("idx")).withColumn("f", start(number))
        for number, (mode, n) in enumerate(dims.items(), start=1)
    }
    return Factors(tables, dims, rank)


def gram(table: DataFrame, rank: int, other: str = "f") -> np.ndarray:
    """Inner products of the factor columns, or of them with the columns of another array.

    Tasks reduce their rows to R x R numbers first.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            if batch.num_rows:
                total += block(batch.column(0)).T @ block(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rank * rank, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "v"])

    both = table.select(F.col("f").alias("_f"), F.col(other).alias("_o"))
    rows = both.mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(rank * rank)
    for r in rows:
        out[r["cell"]] = r["v"]
    return out.reshape(rank, rank)


def _attach(entries: DataFrame | Clustered, factors: Factors, modes: list[str], limit: int | None) -> DataFrame:
    """Entries with the factor arrays of the given modes; a clustered mode comes first, in place."""
    tables = {
        m: factors.tables[m].select(F.col("idx").alias(m), F.col("f").alias(f"_{m}")) for m in modes}
    if isinstance(entries, Clustered):
        if entries.key in tables:
            rows = entries.attach(tables.pop(entries.key))
        else:
            rows = entries.rows.drop("_piece")
    else:
        rows = entries
    for mode, table in tables.items():
        rows = lookup(rows, table, [mode], rows=factors.dims[mode], row_bytes=_row_bytes(factors.rank), limit=limit)
    return rows


def _row_bytes(rank: int) -> int:
    return 8 * rank + 48


def _products(rank: int, modes: list[str], *first: str) -> list[str]:
    """Per component, the product of the attached factors (and other columns) as SQL text."""
    return [" * ".join([*first, *[f"`_{m}`[{r}]" for m in modes]]) for r in range(rank)]


def mode_numerators(
    entries: DataFrame | Clustered, factors: Factors, mode: str, limit: int | None = None
) -> DataFrame:
    """(idx, num): for each value of a mode, the entries times the other modes' factors, summed.

    The R sums are ordinary aggregates, so every task first combines its own rows per index.
    """
    others = [m for m in factors.modes if m != mode]
    rows = _attach(entries, factors, others, limit)
    sums = [F.expr(f"sum({p}) as _s{r}") for r, p in enumerate(_products(factors.rank, others, "value"))]
    grouped = rows.groupBy(F.col(mode).alias("idx")).agg(*sums)
    return grouped.select("idx", F.array(*[f"_s{r}" for r in range(factors.rank)]).alias("num"))


def ncp_step(
    entries: DataFrame | Clustered, factors: Factors, mode: str, grams: dict[str, np.ndarray] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One multiplicative update of one mode: (idx, f, num) with f * num / denominator as the new f."""
    rank = factors.rank
    others = [m for m in factors.modes if m != mode]
    grams = grams or {m: gram(factors.tables[m], rank) for m in others}
    v = reduce(np.multiply, [grams[m] for m in others])
    num = mode_numerators(entries, factors, mode, limit)
    joined = factors.tables[mode].select("idx", "f").join(num, "idx", "left")

    @F.arrow_udf("array<double>")
    def updated(f: pa.Array, num: pa.Array) -> pa.Array:
        old = block(f)
        return lists(old * block(num) / (old @ v + FLOOR))

    num_or_zero = F.coalesce("num", F.lit([0.0] * rank))
    return joined.select("idx", updated("f", num_or_zero).alias("f"), num_or_zero.alias("num"))


def ncp_fit(
    entries: DataFrame, dims: dict[str, int], rank: int = RANK, iterations: int = 200, seed: int = 1,
    tol: float = 1e-4, limit: int | None = None,
) -> tuple[Factors, list[float]]:
    """Factorise entries ``(mode..., value)``; repeated coordinates add up first.

    Stops when the squared error improves by less than ``tol`` of itself. Returns factors and errors.
    Where only one mode is long an iteration is one pass over it (see :class:`_LongMode`). Otherwise
    each update is written before the next reads it, in two folders per mode used in turn.
    """
    modes = list(dims)
    summed = materialize(entries.groupBy(*modes).agg(F.sum("value").alias("value")), "entries")
    factors = initial_factors(entries.sparkSession, dims, rank, seed)
    longest = max(dims, key=dims.get)
    cells = math.prod(n for m, n in dims.items() if m != longest)
    if dims[longest] and 0 < cells <= DENSE_CELLS and fits_broadcast(cells, _row_bytes(rank), limit):
        return _fit_by_rows(summed, factors, longest, iterations, tol)
    rows = summed if fits_broadcast(dims[longest], _row_bytes(rank), limit) else Clustered(summed, longest)
    tables = {m: materialize(t, f"factor_{m}") for m, t in factors.tables.items()}
    factors = Factors(tables, dims, rank)
    grams = {m: gram(tables[m], rank) for m in modes}
    square = summed.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    run, errors = f"ncp-{uuid.uuid4().hex[:12]}", []
    for iteration in range(iterations):
        for mode in modes:
            others = {m: grams[m] for m in modes if m != mode}
            updated = ncp_step(rows, factors, mode, others, limit)
            table = materialize(updated, f"factor_{mode}", slot=f"{run}-{iteration % 2}")
            factors = Factors({**factors.tables, mode: table}, dims, rank)
            grams[mode] = gram(table, rank)
        # |X|^2 - 2 <X, M> + |M|^2; the numerators of the mode updated last already hold X
        inner = np.trace(gram(factors.tables[modes[-1]], rank, "num"))
        errors.append(float(square - 2.0 * inner + reduce(np.multiply, grams.values()).sum()))
        if len(errors) > 1 and errors[-2] - errors[-1] < tol * errors[-2]:
            break
    if isinstance(rows, Clustered):
        rows.release()
    return factors, errors


class _LongMode:
    """The one long mode of a fit: per value its factor and its entries, by cell of the other modes.

    The other modes' factors are few numbers, which every task brings along, so an update joins
    nothing. Tasks reduce their rows to what all other updates need: per cell the entries times the
    factors, and the Gram matrix. New factors are written every few updates only; until then tasks
    repeat the updates since the last written ones, which depend on their own rows alone.
    """

    def __init__(self, summed: DataFrame, factors: Factors, mode: str):
        dims, spark = factors.dims, summed.sparkSession
        self.rank, self.others = factors.rank, [m for m in factors.modes if m != mode]
        self.cells = math.prod(dims[m] for m in self.others)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.run, self.written = f"ncp-{uuid.uuid4().hex[:12]}", 0
        cell = reduce(lambda c, m: c * F.lit(dims[m]) + F.col(m), self.others, F.lit(0).cast("bigint"))
        entry = F.struct(cell.cast("int").alias("cell"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
        # coordinates are summed, so a value has at most one entry per cell
        held = summed.dropna(subset=factors.modes).groupBy(F.col(mode).alias("idx")).agg(F.collect_list(entry).alias("_e"))
        rows = factors.tables[mode].join(held.hint("merge"), "idx", "left")
        parts = max(spark.sparkContext.defaultParallelism, dims[mode] * _row_bytes(self.rank) >> 25)
        laid = rows.select("idx", "f", F.col("_e.cell").alias("cells"), F.col("_e.value").alias("values")).repartition(parts, "idx")
        self.rows = materialize(laid, "rows", slot=f"{self.run}-0")

    def _blocks(self) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
        """Pieces of a batch with their factors after all updates, and their entries as a matrix."""
        cells, steps = self.cells, self.steps

        def run(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            size = max(1, BLOCK_CELLS // cells)
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                f, held = block(piece.column("f")), piece.column("cells")
                n = held.value_lengths().fill_null(0).to_numpy()
                x = np.zeros((piece.num_rows, cells))
                x[np.repeat(np.arange(len(n)), n), held.flatten().to_numpy()] = piece.column("values").flatten().to_numpy()
                for products, v in steps:
                    f = f * (x @ products) / (f @ v + FLOOR)
                yield piece, f, x

        return run

    def update(self, products: np.ndarray, v: np.ndarray) -> None:
        """Multiply by the entries times ``products`` (cells x R) over the factors times ``v``."""
        self.steps = [*self.steps, (products, v)]
        if len(self.steps) >= REPLAY:
            blocks = self._blocks()

            def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for piece, f, _ in blocks(batch):
                        yield pa.RecordBatch.from_arrays(
                            [piece.column("idx"), lists(f), piece.column("cells"), piece.column("values")], names=["idx", "f", "cells", "values"])

            self.written += 1
            self.rows = materialize(self.rows.mapInArrow(after, self.rows.schema), "rows", slot=f"{self.run}-{self.written % 2}")
            self.steps = []

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries times factors, summed per cell (cells x R), and the Gram matrix."""
        cells, rank, blocks = self.cells, self.rank, self._blocks()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((cells + rank, rank))
            for batch in batches:
                for _, f, x in blocks(batch):
                    total[:cells] += x.T @ f
                    total[cells:] += f.T @ f
            at = np.flatnonzero(total.any(axis=1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), lists(total[at])], names=["at", "s"])

        parts = self.rows.mapInArrow(partial, "at int, s array<double>")
        rows = parts.groupBy("at").agg(*[F.sum(F.col("s")[r]).alias(f"_{r}") for r in range(rank)]).collect()
        out = np.zeros((cells + rank, rank))
        for r in rows:
            out[r["at"]] = r[1:]
        return out[:cells], out[cells:]

    def factors(self) -> DataFrame:
        """(idx, f) after all updates."""
        blocks = self._blocks()

        def now(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, f, _ in blocks(batch):
                    yield pa.RecordBatch.from_arrays([piece.column("idx"), lists(f)], names=["idx", "f"])

        return self.rows.mapInArrow(now, "idx bigint, f array<double>")


def _cell_products(small: dict[str, np.ndarray], rank: int) -> np.ndarray:
    """Products of the factors of some modes for every cell of them (cells x R)."""
    return reduce(lambda w, f: (w[:, None] * f).reshape(-1, rank), small.values(), np.ones((1, rank)))


def _fit_by_rows(summed: DataFrame, start: Factors, longest: str, iterations: int, tol: float) -> tuple[Factors, list[float]]:
    """:func:`ncp_fit` with one pass over the long mode per iteration."""
    spark, modes, rank = summed.sparkSession, start.modes, start.rank
    rows = _LongMode(summed, start, longest)
    small = {}
    for m in rows.others:
        found = start.tables[m].orderBy("idx").collect()
        small[m] = np.array([r["f"] for r in found])
    grams = {m: f.T @ f for m, f in small.items()}
    square = summed.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    if modes[0] != longest:
        per_cell, grams[longest] = rows.sums()
    errors = []
    for _ in range(iterations):
        for mode in modes:
            v = reduce(np.multiply, [grams[m] for m in modes if m != mode])
            if mode == longest:
                rows.update(_cell_products(small, rank), v)
                per_cell, grams[longest] = rows.sums()
                continue
            ones = {m: np.ones_like(f) if m == mode else f for m, f in small.items()}
            cube = (per_cell * _cell_products(ones, rank)).reshape(*(len(f) for f in small.values()), rank)
            num = cube.sum(axis=tuple(i for i, m in enumerate(small) if m != mode))
            small[mode] = small[mode] * num / (small[mode] @ v + FLOOR)
            grams[mode] = small[mode].T @ small[mode]
        # |X|^2 - 2 <X, M> + |M|^2
        inner = (per_cell * _cell_products(small, rank)).sum()
        errors.append(float(square - 2.0 * inner + reduce(np.multiply, grams.values()).sum()))
        if len(errors) > 1 and errors[-2] - errors[-1] < tol * errors[-2]:
            break
    tables = {m: spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(small[m])], "idx bigint, f array<double>") for m in small}
    tables[longest] = rows.factors()
    return Factors({m: materialize(tables[m], f"factor_{m}") for m in modes}, start.dims, rank), errors


def ncp_reconstruct(
    coordinates: DataFrame, factors: Factors, out: str = "model", limit: int | None = None
) -> DataFrame:
    """Model value at each given coordinate: the sum over r of the factors' products.

    For a dense table such as a matrix, the coordinates given are all its cells.
    """
    rows = _attach(coordinates, factors, factors.modes, limit)
    value = " + ".join(_products(factors.rank, factors.modes))
    return rows.withColumn(out, F.expr(value)).drop(*[f"_{m}" for m in factors.modes])


def ncp_mask(coordinates: DataFrame, factors: Factors, threshold: float = 0.5, limit: int | None = None) -> DataFrame:
    """Reconstruction ``model``, the same over its maximum ``scaled``, and both cut at a threshold
    (``mask`` and ``scaled_mask``)."""
    rows = materialize(ncp_reconstruct(coordinates, factors, limit=limit), "model")
    return rescale(rows, "model", "scaled").withColumns({
        "mask": binarize("model", threshold), "scaled_mask": binarize("scaled", threshold)})


def normalised(factors: Factors) -> tuple[Factors, np.ndarray]:
    """Factors whose columns sum to 1 in every mode, and the component weights taken out."""
    weights, tables = np.ones(factors.rank), {}
    for mode, table in factors.tables.items():
        sums = table.agg(*[F.sum(F.col("f")[r]) for r in range(factors.rank)]).first()
        scale = np.array([s if s > 0 else 1.0 for s in sums])
        weights *= np.array(list(sums))
        tables[mode] = table.select("idx", F.array(*[F.col("f")[r] / F.lit(float(s)) for r, s in enumerate(scale)]).alias("f"))
    return Factors(tables, factors.dims, factors.rank), weights
