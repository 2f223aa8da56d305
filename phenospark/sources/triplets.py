"""Triplet text: a line of sizes, then one ``patient medication diagnosis`` line per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenospark.functions.scalars import shift_index

HEADER = ("n_records", "n_patient", "n_med", "n_diag")
FIELDS = ("patient", "med", "diag")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", F.split(F.trim("value"), r"\s+").alias("f"))


def read_triplets_text(
    spark: SparkSession, path: str, offset: int = 0, check: bool = True
) -> tuple[DataFrame, dict[str, int]]:
    """Records ``(patient, med, diag)`` and the sizes stated in the header.

    The header is the one line with four fields, wherever the file's part order puts it. ``check``
    compares its record count with the lines present. ``offset`` changes the index base.
    """
    lines = _fields(spark, path)
    heads = lines.where(F.size("f") == 4).select(
        *[F.col("f")[i].cast("bigint").alias(c) for i, c in enumerate(HEADER)]).take(2)
    if len(heads) != 1:
        raise ValueError(f"{path}: expected one header line of four numbers")
    sizes = heads[0].asDict()
    whole = F.forall("f", lambda x: F.rlike(x, F.lit(r"^[+-]?\d+$")))
    bad = lines.where(~F.size("f").isin(3, 4) | ~whole).select("value").take(3)
    if bad:
        raise ValueError(f"{path}: lines that are neither header nor three whole numbers, such as {[r['value'] for r in bad]}")
    records = lines.where(F.size("f") == 3).select(
        *[F.col("f")[i].cast("bigint").alias(c) for i, c in enumerate(FIELDS)])
    if check:
        found = records.count()
        if found != sizes["n_records"]:
            raise ValueError(f"{path}: header says {sizes['n_records']} records, file has {found}")
    return records.select(*[shift_index(c, offset) for c in FIELDS]), sizes


def write_triplets_text(entries: DataFrame, path: str, seed: int = 0, offset: int = 0) -> None:
    """Write entries in random order under a header of sizes (one more than the largest index).

    Records are range-sorted over the cluster by a seeded random number that depends on the record
    alone, so a repeated task gives the same order; equal records are interchangeable lines. The
    header sorts before everything and so opens the first part file.
    """
    sizes = entries.agg(
        F.count(F.lit(1)).alias("n"), *[(F.max(c) + 1).alias(c) for c in FIELDS]
    ).select(F.concat_ws(" ", "n", *FIELDS).alias("value"), F.lit(-1.0).alias("_order"))
    lines = entries.select(
        F.concat_ws(" ", *[shift_index(c, offset) for c in FIELDS]).alias("value"),
        (F.pmod(F.xxhash64(*FIELDS, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("_order"),
    )
    sizes.unionByName(lines).orderBy("_order").select("value").write.text(path)
