"""Rows by their place in an order, without putting all rows in order."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# about how many keys of a table cut it into ranges, and the rows a task may order
SPLITS = 1024
ROWS_IN_RANGE = 100_000


def rows_at(df: DataFrame, key: str, places: list[int], n: int, splits: int = SPLITS, longest: int = ROWS_IN_RANGE) -> DataFrame:
    """(key, _row): the keys at the given 0-based places among the n non-null keys in their order.

    Keys are unique. A hashed sample of keys cuts the table into ranges, one pass counts them, and
    only the ranges that hold a wanted place are looked at again: cut further while they are long,
    then put in order one by one.
    """
    rows = df.where(F.col(key).isNotNull()).select(key)
    dtype = rows.schema[key].dataType
    found = rows.sparkSession.createDataFrame([], f"`{key}` {dtype.simpleString()}, _row bigint")
    # (lowest key, first key beyond, rows before, rows) of the ranges still to look at
    todo, level = [(None, None, 0, n)] if places and n else [], 0
    while todo:
        held = [(lo, hi, before, size) for lo, hi, before, size in todo if size <= longest]
        if held:
            found = found.unionByName(_ordered(rows, key, held, places))
        todo = [r for r in todo if r[3] > longest]
        if not todo:
            break
        inside = rows.where(_within(key, todo))
        total = sum(r[3] for r in todo)
        level += 1
        # other keys at each level, and more than one, so that every level makes ranges shorter
        u = F.shiftrightunsigned(F.xxhash64(F.lit(level), key), 11) / F.lit(float(1 << 53))
        cuts = sorted(r[0] for r in inside.where(u < splits / total).collect())
        edges = sorted({*cuts, *(k for lo, hi, _, _ in todo for k in (lo, hi) if k is not None)})
        counts = _range_counts(inside, key, edges)
        # what no key could cut is one key many times over, and is put in order as it is
        parts = _split(todo, edges, counts, places)
        longest = max([longest, *(r[3] for r in parts if r in todo)])
        todo = parts
    return found


def _within(key: str, ranges: list[tuple]):
    out = F.lit(False)
    for lo, hi, _, _ in ranges:
        here = F.lit(True)
        if lo is not None:
            here = here & (F.col(key) >= F.lit(lo))
        if hi is not None:
            here = here & (F.col(key) < F.lit(hi))
        out = out | here
    return out


def _range_counts(rows: DataFrame, key: str, edges: list) -> dict[int, int]:
    """Rows by how many of the sorted edges are not above them."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(edges)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        at = np.asarray(shared.value, dtype=object if keys.type in (pa.string(), pa.large_string()) else None)
        values = np.asarray(keys.to_pylist(), dtype=object) if at.dtype == object else keys.to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(at, values, "right").astype(np.int32))

    return {r["p"]: r["n"] for r in rows.groupBy(place(key).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _split(todo: list[tuple], edges: list, counts: dict[int, int], places: list[int]) -> list[tuple]:
    """The parts of the ranges that hold a wanted place."""
    out = []
    for lo, hi, before, _ in todo:
        first = 0 if lo is None else bisect.bisect_right(edges, lo)
        last = len(edges) if hi is None else bisect.bisect_left(edges, hi)
        for p in range(first, last + 1):
            size = counts.get(p, 0)
            at = bisect.bisect_left(places, before)
            if size and at < len(places) and places[at] < before + size:
                out.append((edges[p - 1] if p else None, edges[p] if p < len(edges) else None, before, size))
            before += size
    return out


def _ordered(rows: DataFrame, key: str, ranges: list[tuple], places: list[int]) -> DataFrame:
    """The wanted keys of ranges short enough to be put in order, each by itself."""
    spark = rows.sparkSession
    number = F.lit(None).cast("int")
    for i, (lo, hi, _, _) in enumerate(ranges):
        number = F.when(_within(key, [(lo, hi, 0, 0)]), F.lit(i)).otherwise(number)
    before = F.element_at(F.lit([r[2] for r in ranges]), F.col("_range") + 1)
    numbered = rows.where(_within(key, ranges)).withColumn("_range", number)
    row = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1 + before
    wanted = spark.createDataFrame([(p,) for p in places], "_row bigint")
    return numbered.withColumn("_row", row.cast("bigint")).select(key, "_row").join(F.broadcast(wanted), "_row", "left_semi").select(key, "_row")
