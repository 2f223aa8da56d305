"""Many-to-one joins that stay whole and balanced whatever the key frequencies are."""

from __future__ import annotations

import functools
import operator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 0.01
HOT_PARTITIONS = 2
HOT_BUCKETS = 1 << 12


def fits_broadcast(rows: int, row_bytes: int = 64, limit: int | None = None) -> bool:
    """Whether a table of known size may be sent to every executor."""
    return rows * row_bytes <= (BROADCAST_BYTES if limit is None else limit)


def hot_share(parts: int) -> float:
    """The share of all rows from which a key is cut: two mean partitions, 1% at most."""
    return min(HOT_SHARE, HOT_PARTITIONS / parts)


def hot_keys(df: DataFrame, on: list[str], share: float | None = None) -> DataFrame | None:
    """Keys that hold more than ``share`` of all rows, with the number of pieces to cut each into.

    At most 1/share keys can qualify, half the number of shuffle partitions by default. Rows are
    counted by a hash of their key first, which shuffles only these counts; keys are counted one by
    one only where a hash alone holds that many rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = share or hot_share(parts)
    n_rows = F.count(F.lit(1)).alias("_n")
    bucket = F.pmod(F.xxhash64(*on), F.lit(max(HOT_BUCKETS, 16 * parts)))
    sizes = df.groupBy(bucket.alias("_bucket")).agg(n_rows).collect()
    total = sum(r["_n"] for r in sizes)
    crowded = [r["_bucket"] for r in sizes if r["_n"] > share * total]
    if not crowded:
        return None
    counts = df.where(bucket.isin(crowded)).select(*on).groupBy(*on).agg(n_rows)
    heavy = counts.where(F.col("_n") > share * total).collect()
    if not heavy:
        return None
    rows = [tuple(r[c] for c in on) + (max(2, int(2 * parts * r["_n"] / total)),) for r in heavy]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*on).schema.fields)
    return spark.createDataFrame(rows, f"{fields}, _fan int")


def spread(left: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Add ``_piece``: rows of a hot key get one of its pieces, rows with a null key, which no join
    matches, any piece, all others 0."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some_null = functools.reduce(operator.or_, [F.col(c).isNull() for c in on])
    fan = F.coalesce("_fan", F.when(some_null, 2 * parts).otherwise(1))
    # the partition number separates rows that are equal in every column
    piece = F.pmod(F.xxhash64(*left.columns) + F.spark_partition_id(), fan)
    return left.join(F.broadcast(hot), on, "left").withColumn("_piece", piece.cast("int")).drop("_fan")


def repeat(right: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """The counterpart of :func:`spread`: the row of a hot key once per piece."""
    last = F.coalesce("_fan", F.lit(1)) - 1
    pieces = F.explode(F.sequence(F.lit(0), last))
    return right.join(F.broadcast(hot), on, "left").withColumn("_piece", pieces).drop("_fan")


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    rows: int | None = None,
    row_bytes: int = 64,
    limit: int | None = None,
    skewed: bool = True,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, where ``right`` has one row per key.

    A side of known size within the limit is broadcast. Otherwise both sides shuffle on the key,
    and keys that dominate ``left`` are salted: their rows spread over several partitions and the
    single matching row of ``right`` is repeated once per piece. Pass ``skewed=False`` when few
    rows can share a key; it saves the pass that looks for dominating keys. That pass reads
    ``measured`` where it is given: a table with these keys that costs less than ``left`` to read
    again. Rows whose key is null match nothing; if they dominate, they are dealt out too.
    """
    if rows is not None and fits_broadcast(rows, row_bytes, limit):
        return left.join(F.broadcast(right), on, how)
    hot = hot_keys(left if measured is None else measured, on) if skewed else None
    keys = on
    if hot is not None:
        left, right, keys = spread(left, on, hot), repeat(right, on, hot), on + ["_piece"]
    # Spark's own guess counts an array as one element and might broadcast what doesn't fit
    return left.join(right if rows is None else right.hint("merge"), keys, how).drop("_piece")


class Clustered:
    """Rows kept hash-partitioned by one long key for a loop that joins them again and again.

    The rows move once. Later joins on the key shuffle only the other side, and hot keys are cut
    into pieces beforehand. Lost blocks are rebuilt from the source of ``df``, so that should be a
    written table.
    """

    def __init__(self, df: DataFrame, key: str):
        self.key = key
        self.hot = hot_keys(df, [key])
        self.on = [key] if self.hot is None else [key, "_piece"]
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid = df if self.hot is None else spread(df, [key], self.hot)
        self.rows = laid.repartition(parts, *self.on).persist(StorageLevel.MEMORY_AND_DISK)
        # fills the cache: its layout counts for later plans only once it is there
        self.rows.count()

    def attach(self, right: DataFrame, how: str = "inner") -> DataFrame:
        """Join with a table of one row per key."""
        copies = right if self.hot is None else repeat(right, [self.key], self.hot)
        return self.rows.join(copies, self.on, how).drop("_piece")

    def release(self) -> None:
        self.rows.unpersist()
