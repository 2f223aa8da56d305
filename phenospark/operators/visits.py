"""Visits: what was diagnosed and what was given, per subject and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenospark.functions.scalars import DAY_ORIGIN, relative_day
from phenospark.operators.asof import asof_backward
from phenospark.runtime import materialize

VISIT = ["subject_id", "day"]


def with_day(events: DataFrame, item: str, origin: str = DAY_ORIGIN) -> DataFrame:
    """Distinct (subject, relative day, item); every later step works on sets of items."""
    return events.select("subject_id", relative_day("date", origin).alias("day"), item).dropna().distinct()


def assign_visit_day(
    medication: DataFrame, diagnostic: DataFrame, tolerance: int = 7, origin: str = DAY_ORIGIN, strategy: str | None = None
) -> DataFrame:
    """Medication rows with the diagnosis day each belongs to: (subject_id, day, med_name, assigned).

    The rows are distinct, so a subject has at most one per medication and day: no key dominates.
    """
    return asof_backward(
        with_day(medication, "med_name", origin),
        diagnostic.select("subject_id", relative_day("date", origin).alias("day")),
        ["subject_id"], "day", "day", tolerance, "assigned", strategy, skewed=False,
    )


def visit_sides(
    medication: DataFrame,
    diagnostic: DataFrame,
    tolerance: int = 7,
    origin: str = DAY_ORIGIN,
    strategy: str | None = None,
    debug_dir: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The two long tables of visits: (subject, day, code) and (subject, day, med_name). Rows may
    repeat; visits take them as sets.

    ``debug_dir`` also writes the dated diagnoses and the assigned medications as CSV.
    """
    codes = diagnostic.select("subject_id", relative_day("date", origin).alias("day"), "code").dropna()
    # rows are not made distinct first: that would shuffle all of them for the few that meet a diagnosis.
    # Where very many repeat on one day, Spark cuts the crowded partition of the join
    dated = medication.select("subject_id", relative_day("date", origin).alias("day"), "med_name").dropna()
    days = diagnostic.select("subject_id", relative_day("date", origin).alias("day"))
    assigned = asof_backward(dated, days, ["subject_id"], "day", "day", tolerance, "assigned", strategy, skewed=False)
    if debug_dir:
        diagnostic.select("subject_id", "code", relative_day("date", origin).alias("date")).write.csv(
            f"{debug_dir}/diag", header=True)
        # written, as the join below reads them once more for its frequent keys
        rows = materialize(medication.select("subject_id", "med_name", relative_day("date", origin).alias("day")), "dated")
        asof_backward(rows, codes, ["subject_id"], "day", "day", tolerance, "assignment", strategy).select(
            "subject_id", "med_name", F.col("day").alias("date"), "assignment"
        ).write.csv(f"{debug_dir}/med", header=True)
    meds = (
        assigned.where(F.col("assigned").isNotNull())
        .select("subject_id", F.col("assigned").alias("day"), "med_name")
    )
    return codes, meds


# a visit with more pairs than this is cut into pieces that any task may take
PAIRS_PER_PIECE = 1 << 16


def _visit_arrays(codes: DataFrame, meds: DataFrame) -> DataFrame:
    """One row per visit that has both sides; its arrays are no longer than the item dictionaries."""
    left = codes.groupBy(*VISIT).agg(F.collect_set("code").alias("codes"))
    right = meds.groupBy(*VISIT).agg(F.collect_set("med_name").alias("meds"))
    return left.join(right, VISIT)


def build_visits(medication: DataFrame, diagnostic: DataFrame, **options) -> DataFrame:
    """One row per visit that has both sides, with sorted arrays of its codes and medications."""
    visits = _visit_arrays(*visit_sides(medication, diagnostic, **options))
    return visits.withColumns({"codes": F.array_sort("codes"), "meds": F.array_sort("meds")})


def _cut(items: str, width):
    """An array cut into pieces of ``width`` items."""
    starts = F.sequence(F.lit(1).cast("bigint"), F.size(items).cast("bigint"), width)
    return F.transform(starts, lambda i: F.slice(items, i.cast("int"), width.cast("int")))


def pairs_of(visits: DataFrame, limit: int | None = None) -> DataFrame:
    """Every (code, medication) of every visit (subject, day, codes, meds).

    The pairs are the result itself, so their number can't be avoided, but a visit's pairs need not
    come from one task: beyond ``limit`` pairs the medications are cut into pieces, each goes with a
    copy of the codes (which are cut too if they alone exceed the limit), and the pieces are dealt
    out before they are multiplied.
    """
    limit = PAIRS_PER_PIECE if limit is None else limit
    n = F.size("codes").cast("bigint") * F.size("meds")
    product = lambda df: df.withColumn("code", F.explode("codes")).select(*VISIT, "code", F.explode("meds").alias("med_name"))
    # sorted, so that a repeated task cuts the same pieces
    large = visits.where(n > limit).withColumns({"codes": F.array_sort("codes"), "meds": F.array_sort("meds")})
    codes = large.withColumn("codes", F.explode(_cut("codes", F.lit(limit).cast("bigint"))))
    width = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.size("codes"))).cast("bigint")
    pieces = codes.withColumn("meds", F.explode(_cut("meds", width)))
    parts = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, *VISIT, F.xxhash64("codes", "meds"))
    return product(visits.where(n <= limit)).unionByName(product(dealt))


def visit_pairs(medication: DataFrame, diagnostic: DataFrame, **options) -> DataFrame:
    """Every (code, medication) of every visit: each is an entry of the tensor. Both sides hold
    distinct items, so nothing is paired twice."""
    return pairs_of(_visit_arrays(*visit_sides(medication, diagnostic, **options)))
