import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from phenospark.operators import joins
from phenospark.operators.asof import STRATEGIES, asof_backward
from phenospark.operators.tensor import build_tensor, number_entries, tensor_from_pairs
from phenospark.operators.visits import build_visits, pairs_of, visit_pairs, visit_sides
from phenospark.plans import proxy


def assign(spark, meds, visits, strategy, tolerance=7):
    left = spark.createDataFrame(meds, "subject_id long, day int")
    right = spark.createDataFrame(visits, "subject_id long, day int")
    out = asof_backward(left, right, ["subject_id"], "day", "day", tolerance, "assigned", strategy)
    return sorted((r["subject_id"], r["day"], r["assigned"]) for r in out.collect())


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_edges(spark, strategy):
    meds = [(1, d) for d in (9, 10, 13, 14, 20, 21)] + [(2, 10)]
    got = assign(spark, meds, [(1, 10), (1, 14)], strategy)
    assert [a for _, _, a in got] == [None, 10, 10, 14, 14, None, None]


def test_unfit_strategies(spark):
    with pytest.raises(ValueError):
        assign(spark, [(1, 1)], [(1, 1)], "window")
    with pytest.raises(ValueError):
        assign(spark, [(1, 1)], [(1, 1)], "bits", tolerance=32)


def test_longest_tolerances(spark):
    meds, visits = [(1, d) for d in range(-70, 70)], [(1, d) for d in (-64, -31, -30, 0, 31, 60)]
    for tolerance in (31, 40):
        got = {s: assign(spark, meds, visits, s, tolerance) for s in (None, "bucket", "expand")}
        assert got[None] == got["bucket"] == got["expand"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    meds=st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 20)), min_size=1, max_size=20),
    visits=st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 20)), min_size=1, max_size=20),
    tolerance=st.integers(1, 9),
)
def test_against_brute_force(spark, meds, visits, tolerance):
    def nearest(subject, day):
        days = [v for s, v in visits if s == subject and 0 <= day - v < tolerance]
        return max(days) if days else None

    want = sorted(((s, d, nearest(s, d)) for s, d in meds), key=str)
    for strategy in STRATEGIES:
        assert sorted(assign(spark, meds, visits, strategy, tolerance), key=str) == want


def test_one_subject_holding_most_rows(spark):
    """A key with most of the rows is cut into pieces and loses none of them."""
    left = spark.range(3000).selectExpr("if(id % 3 < 2, 7, id) as key", "id as n")
    right = spark.range(3000).selectExpr("id as key", "id * 2 as twice")
    hot = joins.hot_keys(left, ["key"])
    assert [r["key"] for r in hot.collect()] == [7] and hot.first()["_fan"] >= 2
    assert joins.spread(left, ["key"], hot).where("key = 7").select("_piece").distinct().count() == hot.first()["_fan"]
    got = joins.lookup(left, right, ["key"], rows=3000, limit=0)
    assert got.count() == 3000
    assert got.where("twice <> key * 2").count() == 0
    kept = joins.Clustered(left, "key")
    assert sorted(map(tuple, kept.attach(right).select("n", "twice").collect())) == sorted(map(tuple, got.select("n", "twice").collect()))
    kept.release()


def test_frequent_keys_are_looked_for_in_stored_rows(spark, monkeypatch, tmp_path):
    """Looking for keys to cut repeats no join: neither in the medication view nor in its dump."""
    spark.range(40).selectExpr("id as l_orderkey", "id % 5 as l_partkey", "timestamp '2020-01-02' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "timestamp '2020-01-01' as o_orderdate", "'a' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).selectExpr("id as p_partkey", "concat('b', id) as p_brand").write.parquet(f"{tmp_path}/part.parquet")
    read, real = [], joins.hot_keys

    def watched(df, on, share=None):
        read.append(df._jdf.queryExecution().analyzed().toString())
        return real(df, on, share)

    monkeypatch.setattr(joins, "hot_keys", watched)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    med = proxy.medication(spark, str(tmp_path))
    visit_sides(med, proxy.diagnostic(spark, str(tmp_path)), debug_dir=f"{tmp_path}/debug")
    dump = spark.read.csv(f"{tmp_path}/debug/med", header=True)
    assert dump.count() == 40 and dump.where("assignment + 1 = date").count() == 40
    assert len(read) == 3 and not [p for p in read if "Join" in p]


def test_keys_that_only_share_a_hash_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_BUCKETS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = spark.range(2000).selectExpr("if(id < 100, 7, id) as key", "id as n")
        assert [r["key"] for r in joins.hot_keys(rows, ["key"]).collect()] == [7]
        assert joins.hot_keys(spark.range(2000).withColumnRenamed("id", "key"), ["key"]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_table_too_large_by_its_known_size_is_not_broadcast(spark):
    """Whatever Spark takes its size to be: arrays count as one element there."""
    left = spark.range(100).selectExpr("id as key")
    right = spark.range(100).selectExpr("id as key", "array_repeat(1.0D, 30) as f")
    plan = joins.lookup(left, right, ["key"], rows=100, limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("keys", [50, 500])
def test_clustered_rows_do_not_move_again(spark, keys):
    """With hot keys (each of 50 holds 2%) and without."""
    kept = joins.Clustered(spark.range(1000).selectExpr(f"id % {keys} as key", "id as n"), "key")
    assert (kept.hot is not None) == (keys == 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = kept.attach(spark.range(keys).selectExpr("id as key", "id + 1 as v"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before_cache = plan.split("InMemoryRelation")[0]
    assert "SortMergeJoin" in before_cache and "Exchange" not in before_cache
    assert joined.count() == 1000
    kept.release()


def events(spark, meds, codes):
    m = spark.createDataFrame(meds, "subject_id long, date string, med_name string")
    d = spark.createDataFrame(codes, "subject_id long, date string, code string")
    return m, d


def test_visit_product_and_multiplicity(spark):
    m, d = events(
        spark,
        [(1, "2500-07-01", "x"), (1, "2500-07-02", "y"), (1, "2500-07-02", "y"), (1, "2500-08-01", "x"), (3, "2500-07-01", "x")],
        [(1, "2500-07-01", "a"), (1, "2500-07-01", "b"), (1, "2500-08-01", "a"), (2, "2500-07-01", "a")],
    )
    visits = build_visits(m, d).orderBy("day").collect()
    assert [(r["codes"], r["meds"]) for r in visits] == [(["a", "b"], ["x", "y"]), (["a"], ["x"])]
    pairs = visit_pairs(m, d)
    assert pairs.count() == 5
    bag, binary = build_tensor(m, d), build_tensor(m, d, "binary")
    assert (bag.entries.count(), binary.entries.count()) == (5, 4)
    assert bag.dims == {"patient": 1, "diag": 2, "med": 2}
    with pytest.raises(ValueError):
        tensor_from_pairs(pairs, "other")


def test_debug_files(spark, tmp_path):
    m, d = events(spark, [(1, "2500-07-01", "x")], [(1, "2500-06-30", "a")])
    build_visits(m, d, debug_dir=str(tmp_path)).count()
    med = spark.read.csv(f"{tmp_path}/med", header=True).collect()
    assert [(r["date"], r["assignment"]) for r in med] == [("9", "8")]


def test_repeated_coordinates_get_their_own_numbers(spark):
    entries = spark.range(60).selectExpr("id % 2 as patient", "0L as diag", "0L as med")
    got = number_entries(entries)
    assert sorted(r["rec_id"] for r in got.collect()) == list(range(60))


@pytest.mark.parametrize("limit", [None, 1, 7, 1000])
def test_a_large_visit_is_cut_into_pieces(spark, limit):
    rows = [(1, 1, ["a", "b"], ["x"]), (1, 2, [f"c{i}" for i in range(60)], [f"m{i}" for i in range(90)]), (2, 1, [f"c{i}" for i in range(400)], ["y"])]
    visits = spark.createDataFrame(rows, "subject_id bigint, day int, codes array<string>, meds array<string>")
    got = sorted(map(tuple, pairs_of(visits, limit).collect()))
    assert got == sorted((s, d, c, m) for s, d, codes, meds in rows for c in codes for m in meds)


def test_a_visit_with_a_third_of_the_pairs_spreads_over_tasks(spark):
    many = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: i.cast("string"))
    few = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string"))
    id_ = F.col("id")
    visits = spark.range(1800).select(
        id_.alias("subject_id"), F.lit(1).alias("day"), F.when(id_ == 0, many).otherwise(few).alias("codes"), F.when(id_ == 0, many).otherwise(few).alias("meds"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = pairs_of(visits, 1000)
        assert pairs.count() == 90_000 + 1799 * 100
        tasks = [r["count"] for r in pairs.where("subject_id = 0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 90_000 and len(tasks) == 4 and max(tasks) < 45_000


def test_visits_take_repeated_rows_without_a_distinct_before_the_join(spark):
    """All medications are shuffled once; a later diagnosis without a code still takes its days."""
    med = spark.createDataFrame([(1, "a", "2500-01-02"), (1, "a", "2500-01-02"), (1, "a", "2500-01-03"), (1, "b", "2500-01-05"), (2, "c", "2500-01-02"), (None, "a", "2500-01-02")],
                                "subject_id long, med_name string, date string")
    diag = spark.createDataFrame([(1, "x", "2500-01-01"), (1, "x", "2500-01-01"), (1, None, "2500-01-04")], "subject_id long, code string, date string")
    pairs = visit_pairs(med, diag).select("subject_id", "code", "med_name").collect()
    assert pairs == [(1, "x", "a")]
    plan = visit_sides(med, diag)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not [line for line in plan.splitlines() if "Aggregate" in line and "med_name" in line]
