import pandas as pd
import pytest
from pyspark.sql import functions as F

from phenospark.operators import axis as A
from phenospark.operators.joins import lookup
from phenospark.operators.mixture import seed_components
from phenospark.operators.order import rows_at
from phenospark.runtime import materialize

# in codepoint order
NAMES = ["Quarl 5%", "Sorvine", "Sorvine Mist", "Sorvine-q", "Tepnil", "Tepnil (Half)", "Zub", "brellin"]


@pytest.mark.parametrize("parts", [None, 1, 5, 50])
def test_sorted_dense_index(spark, parts):
    df = spark.createDataFrame([(n,) for n in reversed(NAMES * 3)] + [(None,)], "name string")
    axis = A.build_axis(df, "name", "med", parts)
    assert axis.size == len(NAMES)
    assert {r["key"]: r["idx"] for r in axis.table.collect()} == {n: i for i, n in enumerate(NAMES)}


def test_numbers_sort_as_numbers(spark):
    df = spark.createDataFrame([(10,), (9,), (100,)], "id long")
    rows = A.build_axis(df, "id", "patient").table.orderBy("idx").collect()
    assert [r["key"] for r in rows] == [9, 10, 100]


@pytest.mark.parametrize("limit", [None, 0])
def test_encode_and_decode(spark, limit):
    df = spark.range(500).selectExpr("concat('k', if(id % 3 < 2, 0, id)) as key", "id")
    axis = A.build_axis(df, "key", "k")
    coded = A.encode_axis(df, axis, "key", "i", limit=limit)
    back = A.decode_axis(coded, axis, "i", "again", limit=limit)
    assert back.count() == 500
    assert back.where("again <> key").count() == 0


def test_compaction(spark):
    df = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 12)], "rec_id long, k long")
    got = {r["rec_id"]: r["k_compact"] for r in A.compact_components(df).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 2}


def test_index_is_written_once_without_a_window(spark, monkeypatch):
    written = []
    monkeypatch.setattr(A, "materialize", lambda df, name, slot=None: (written.append(df), plain(df, name, slot))[1])
    plain = materialize
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("id"))
    table, n = A.dense_index(df, ["id"], "i", parts=9)
    assert n == 200_000 and len(written) == 1
    assert "Window" not in table._jdf.queryExecution().executedPlan().toString() + written[0]._jdf.queryExecution().executedPlan().toString()
    want = spark.createDataFrame(pd.DataFrame({"id": sorted(i * 7919 % 200_003 for i in range(200_000)), "want": range(200_000)}))
    assert table.join(want, "id").where("i = want").count() == 200_000


def test_index_of_equal_and_no_rows(spark):
    df = spark.range(3000).select(F.lit(1).alias("a"), (F.col("id") % 2).alias("b"))
    table, n = A.dense_index(df, ["a"], "i", unique=False, parts=6)
    assert n == 3000 and sorted(r["i"] for r in table.collect()) == list(range(3000))
    assert A.dense_index(df.limit(0), ["a"], "i")[1] == 0 and A.build_axis(df.limit(0), "a", "a").size == 0


def test_axis_width_decides_the_join(spark):
    """Long keys count by their bytes: the same number of rows is sent or shuffled."""
    short, long = (A.build_axis(spark.range(50).select(F.concat(F.repeat(F.lit("x"), n), F.col("id").cast("string")).alias("key")), "key", "k") for n in (1, 5000))
    assert short.row_bytes < 80 and long.row_bytes > 5000
    df = spark.range(10).select(F.col("id").cast("string").alias("key"))
    plan = lambda axis: A.encode_axis(df, axis, "key", "i", limit=50_000)._jdf.queryExecution().optimizedPlan().toString()
    # the longer one is dealt out, each of the ten keys in pieces
    assert "_piece" not in plan(short) and "_piece" in plan(long)


def test_null_keys_are_dealt_out(spark):
    """Rows without a key, two thirds of all, spread over tasks in a left join and keep their row."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).alias("key"), "id").repartition(4)
    right = spark.range(5).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lookup(df, right, ["key"], "left", rows=5, limit=0)
        nulls = out.where("key is null").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert out.count() == 3000 and out.where("v = key * 10").count() == 1000 and len(nulls) >= 3
        assert lookup(df, right, ["key"], "left_semi", rows=5, limit=0).count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("splits, longest", [(1024, 100_000), (8, 50), (3, 10)])
def test_rows_by_number(spark, splits, longest):
    keys = sorted({i * i % 100_003 for i in range(1, 2000)})
    df = spark.createDataFrame([(k, str(k).zfill(6)) for k in keys] + [(None, None)], "n bigint, s string").repartition(5)
    places = [0, 1, 700, 701, len(keys) - 1]
    for column, cast in (("n", int), ("s", lambda k: str(k).zfill(6))):
        got = {r["_row"]: r[column] for r in rows_at(df, column, places, len(keys), splits, longest).collect()}
        assert got == {p: cast(keys[p]) for p in places}
    assert rows_at(df, "n", [], len(keys)).count() == 0 == rows_at(df.limit(0), "n", [1], 0).count()


def test_start_of_a_mixture_orders_nothing_globally(spark):
    df = spark.range(1000).select("id", F.array(F.col("id").cast("double")).alias("v"))
    plan = seed_components(df, "id", "v", 3, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "RepartitionByExpression" not in plan and "partitionBy" not in plan
