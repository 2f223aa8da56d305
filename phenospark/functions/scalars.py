"""Column expressions: dates, thresholds, scaling and names. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Calendar origin of relative days, and the shape of a table name at a path's end.
DAY_ORIGIN = "2500-06-22"
TABLE_NAME_PATTERN = r"(\w+)(\.csv)?$"


def relative_day(date: Column | str, origin: str = DAY_ORIGIN) -> Column:
    """Whole days from ``origin`` to ``date`` (negative before it)."""
    return F.date_diff(F.to_date(date), F.lit(origin).cast("date"))


def binarize(value: Column | str, threshold: float = 0.5) -> Column:
    """0 below the threshold, 1 above it; a value equal to it stays as it is."""
    v = F.col(value) if isinstance(value, str) else value
    t = F.lit(float(threshold))
    return F.when(v < t, F.lit(0.0)).when(v > t, F.lit(1.0)).otherwise(v)


def rescale(df: DataFrame, value: str, out: str, by: float | None = None) -> DataFrame:
    """Divide a column by a constant, or by its maximum over the table (a scalar subquery)."""
    base = F.lit(float(by)) if by is not None else df.agg(F.max(value)).scalar()
    return df.withColumn(out, F.col(value) / base)


def table_name_of(path: Column | str) -> Column:
    """View name of a path: its trailing word without ``.csv``, or the path when there is none."""
    p = F.col(path) if isinstance(path, str) else path
    word = F.regexp_extract(p, TABLE_NAME_PATTERN, 1)
    return F.when(word == "", p).otherwise(word)


def argmax_component(weights: Column | str) -> Column:
    """0-based position of the largest entry of an array; ties go to the lowest position."""
    return F.array_position(weights, F.array_max(weights)).cast("int") - 1


def shift_index(column: str, offset: int) -> Column:
    """Change of index base."""
    return (F.col(column) + F.lit(offset)).alias(column)
