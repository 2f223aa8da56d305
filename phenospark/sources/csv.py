"""CSV tables, clinical event files, candidate lists and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from phenospark import schema as S
from phenospark.functions.scalars import table_name_of


def _name_of(spark: SparkSession, path: str) -> str:
    return spark.range(1).select(table_name_of(F.lit(path)).alias("name")).first()["name"]


def _register(df: DataFrame, name: str) -> None:
    # quoted, because a file may be called 2024.csv
    df.createOrReplaceTempView(f"`{name}`")


def read_csv_table(
    spark: SparkSession, path: str, name: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Read a CSV with a header and register it as a view, named after the path unless told.

    Columns are strings unless a schema is given; nothing is inferred, so the file is read once.
    """
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False if schema else None)
    _register(df, name or _name_of(spark, path))
    return df


def _columns_of(spark: SparkSession, path: str, wanted: T.StructType) -> DataFrame:
    """The wanted columns by header name, cast; a missing column is an error."""
    df = spark.read.csv(path, header=True)
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    keep = lambda f: F.col(f.name) if isinstance(f.dataType, T.StringType) else F.trim(f.name).cast(f.dataType)
    return df.select(*[keep(f).alias(f.name) for f in wanted])


def read_events(spark: SparkSession, medication_path: str, diagnostic_path: str) -> tuple[DataFrame, DataFrame]:
    """Medication and diagnosis files: only the needed columns are parsed, dates become DATE."""
    med = _columns_of(spark, medication_path, S.MEDICATION_CSV)
    diag = _columns_of(spark, diagnostic_path, S.DIAGNOSTIC_CSV)
    return tuple(df.withColumn("date", F.to_date(F.trim(F.col("date").cast("string")))) for df in (med, diag))


def load_clinical_events(
    spark: SparkSession, medication_path: str, lab_path: str, diagnostic_path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three typed event tables, each also registered as a view: medication, lab, diagnostic."""
    tables = []
    for path, layout in ((medication_path, S.MEDICATION), (lab_path, S.LAB_RESULT), (diagnostic_path, S.DIAGNOSTIC)):
        df = _columns_of(spark, path, layout)
        _register(df, _name_of(spark, path))
        tables.append(df)
    return tuple(tables)


def read_candidate_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-cased items, one per line of the file: (item)."""
    return spark.read.text(path).select(F.lower("value").alias("item")).where("item <> ''").distinct()


# every key is quoted, and nothing of it is trimmed or taken for null
EXACT_CSV = {
    "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "lineSep": "\n",
}


def write_dictionary(table: DataFrame, path: str) -> None:
    """A dictionary as CSV without header: key, index."""
    table.select("key", "idx").write.csv(path, **EXACT_CSV, quoteAll=True)


def read_dictionary(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """(key, idx) of a dictionary file; any text is a key: empty, with blanks, commas, quotes or line ends."""
    df = spark.read.csv(path, schema=S.DICTIONARY, multiLine=True, **EXACT_CSV)
    return df.withColumn("key", F.col("key").cast(key_type))
