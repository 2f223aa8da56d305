"""Dense 0-based indexes in sorted order, and encoding through them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from phenospark.operators.joins import lookup
from phenospark.runtime import materialize

# monotonically_increasing_id keeps the task's number above this bit, the row's number in it below
POSITION_BITS = 33


@dataclass(frozen=True)
class Axis:
    """A dictionary ``(key, idx)`` with its number of rows and their mean size in bytes."""

    name: str
    table: DataFrame
    size: int
    row_bytes: int = 64


def dense_index(
    df: DataFrame, order: list[str], out: str, unique: bool = True, parts: int | None = None
) -> tuple[DataFrame, int]:
    """Number the rows of ``df`` 0, 1, 2, ... in the given order; also return how many there are.

    The rows are range-partitioned, sorted and written once, each with its task and its place in
    it. The rows of each task are then counted, and reading adds the count of the tasks before.
    Only these counts reach the driver, and no task holds more than its range. With
    ``unique=False`` rows may tie in ``order``; a tie-breaker keeps many equal rows from falling
    into one range. ``parts`` is the number of ranges, by default Spark's number of partitions.
    """
    if not unique:
        df, order = df.withColumn("_tie", F.monotonically_increasing_id()), [*order, "_tie"]
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop("_tie")
    table = materialize(ranged, "indexed")
    part = F.shiftright("_at", POSITION_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for i in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(i, 0)
    base = F.element_at(F.lit(offsets or [0]), part + 1).cast("bigint")
    place = F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return table.withColumn(out, base + place).drop("_at"), before


def key_bytes(column: str = "key"):
    """Size in bytes of a key as text; an upper bound for numbers."""
    return F.octet_length(F.to_json(F.struct(column)))


def build_axis(df: DataFrame, column: str, name: str, parts: int | None = None) -> Axis:
    """Dictionary of the distinct non-null values of a column, indexed in sorted order, with the
    size that decides how it is joined."""
    keys = df.select(F.col(column).alias("key")).dropna().distinct()
    table, n = dense_index(keys, ["key"], "idx", parts=parts)
    width = table.agg(F.avg(key_bytes())).first()[0] or 0.0
    # a row in a hash table costs its key, its index and about three pointers
    return Axis(name, table, n, int(width) + 40)


def encode_axis(df: DataFrame, axis: Axis, column: str, out: str, how: str = "inner", limit: int | None = None) -> DataFrame:
    """Add the index of ``column`` as ``out``."""
    table = axis.table.select(F.col("key").alias(column), F.col("idx").alias(out))
    return lookup(df, table, [column], how, rows=axis.size, row_bytes=axis.row_bytes, limit=limit)


def decode_axis(df: DataFrame, axis: Axis, column: str, out: str, how: str = "inner", limit: int | None = None) -> DataFrame:
    """Add the key behind an index column as ``out``."""
    table = axis.table.select(F.col("idx").alias(column), F.col("key").alias(out))
    return lookup(df, table, [column], how, rows=axis.size, row_bytes=axis.row_bytes, limit=limit)


def compact_components(assigned: DataFrame, column: str = "k", out: str = "k_compact") -> DataFrame:
    """Renumber the component ids in use 0, 1, 2, ... in their order, on every assigned row."""
    return encode_axis(assigned, build_axis(assigned, column, "component"), column, out)
