"""Backward as-of join with a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenospark.operators.joins import lookup

STRATEGIES = ("bits", "bucket", "expand")
# two blocks of days must fit the bits of a BIGINT
LONGEST_FOR_BITS = 31


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    tolerance: int = 7,
    out: str = "assigned",
    strategy: str | None = None,
    skewed: bool = True,
) -> DataFrame:
    """Give each left row the latest right day of the same key that is on or before its own day
    and fewer than ``tolerance`` days away; null when there is none. Days are whole numbers.

    All strategies turn the range condition into an equality with one right row per key, so no
    pair of rows is ever produced and then filtered, and a key with very many rows is spread over
    its days:

    ``bits``    days are cut into blocks of ``tolerance``; each right day serves its own block and
                the next, and a block is one number with a bit per day. Everything stays in
                generated code. The default up to 31 days.
    ``bucket``  the same blocks as lists of at most 2 * tolerance days. The default beyond.
    ``expand``  each right day is written once per day it can serve; the latest one is kept.

    ``skewed`` is passed on to :func:`lookup`: leave it set unless the left rows are already
    reduced to few per key and day.
    """
    if strategy is None:
        strategy = "bits" if tolerance <= LONGEST_FOR_BITS else "bucket"
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "bits" and tolerance > LONGEST_FOR_BITS:
        raise ValueError(f"strategy 'bits' needs a tolerance of at most {LONGEST_FOR_BITS} days")
    days = right.select(*by, F.col(right_on).cast("int").alias("_day")).dropna().distinct()
    if strategy == "expand":
        served = days.withColumn("_on", F.explode(F.sequence("_day", F.col("_day") + F.lit(tolerance - 1))))
        latest = served.groupBy(*by, "_on").agg(F.max("_day").alias(out))
        keyed = left.withColumn("_on", F.col(left_on).cast("int"))
        return lookup(keyed, latest, by + ["_on"], "left", skewed=skewed).drop("_on")

    def block(day):
        return F.floor(day / F.lit(tolerance))

    served = days.withColumn("_block", F.explode(F.array(block(F.col("_day")), block(F.col("_day")) + 1)))
    keyed = left.withColumn("_block", block(F.col(left_on)))
    if strategy == "bucket":
        lists = served.groupBy(*by, "_block").agg(F.collect_list("_day").alias("_days"))
        joined = lookup(keyed, lists, by + ["_block"], "left", skewed=skewed)
        here = F.col(left_on)
        found = F.array_max(F.filter("_days", lambda d: (d <= here) & (here - d < tolerance)))
        return joined.withColumn(out, found).drop("_block", "_days")

    # bit p stands for the p-th day from the first day of the block before
    first = f"cast((_block - 1) * {tolerance} as int)"
    marks = served.groupBy(*by, "_block").agg(F.expr(f"bit_or(shiftleft(1L, _day - {first}))").alias("_bits"))
    joined = lookup(keyed, marks, by + ["_block"], "left", skewed=skewed)
    # days after the left one are masked, those out of reach are shifted out; the highest is left
    here = f"(cast(`{left_on}` as int) - {first})"
    reach = f"shiftright(_bits & (shiftleft(1L, {here} + 1) - 1), {here} - {tolerance - 1})"
    found = f"case when {reach} > 0 then {first} + {here} - {tolerance - 1} + cast(floor(log2({reach})) as int) end"
    return joined.withColumn(out, F.expr(found)).drop("_block", "_bits")
