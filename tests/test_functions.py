import math

import numpy as np
from pyspark.sql import functions as F

from phenospark.functions import rand as R
from phenospark.functions import scalars as S
from phenospark.functions.special import lgamma, np_lgamma


def test_table_names(spark):
    paths = ["d/foo.csv", "foo", "d/foo.txt", "d/"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    got = [r["n"] for r in df.orderBy("i").select(S.table_name_of("path").alias("n")).collect()]
    assert got == ["foo", "foo", "txt", "d/"]


def test_threshold(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (0.9,)], "v double")
    assert [r[0] for r in df.orderBy("v").select(S.binarize("v")).collect()] == [0.0, 0.5, 1.0]


def test_rescale(spark):
    df = spark.createDataFrame([(1.0,), (4.0,)], "v double")
    assert sorted(r["s"] for r in S.rescale(df, "v", "s").collect()) == [0.25, 1.0]
    assert sorted(r["s"] for r in S.rescale(df, "v", "s", by=2).collect()) == [0.5, 2.0]


def test_days_before_and_after_the_origin(spark):
    df = spark.createDataFrame([("2500-06-21",), ("2500-06-23",)], "d string")
    assert [r[0] for r in df.orderBy("d").select(S.relative_day("d")).collect()] == [-1, 1]


def test_argmax_takes_the_lowest_of_ties(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(S.argmax_component("p")).first()[0] == 1


def test_lgamma(spark):
    xs = [1e-9, 0.0078125, 0.5, 1.0, 2.0, 9.99, 50.0, 999.9, 1000.1, 1e9]
    want = np.array([math.lgamma(x) for x in xs])
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = np.array([r["g"] for r in df.select("x", lgamma("x").alias("g")).orderBy("x").collect()])
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(np_lgamma(np.array(xs)), want, rtol=1e-12, atol=1e-12)


def test_uniforms_agree_and_look_uniform(spark):
    n = 20000
    df = spark.range(n).select("id", R.uniform("id", 5, 6).alias("u"), R.uniform(F.col("id") * 7 + (1 << 40), 5, 6).alias("v"))
    pdf = df.orderBy("id").toPandas()
    ids = np.arange(n)
    assert np.array_equal(pdf["u"], R.np_uniform(ids, 5, 6))
    assert np.array_equal(pdf["v"], R.np_uniform(ids * 7 + (1 << 40), 5, 6))
    for u in (pdf["u"].to_numpy(), R.np_uniform(ids, 1, 2)):
        assert 0 < u.min() and u.max() < 1
        counts = np.bincount((u * 20).astype(int), minlength=20)
        assert ((counts - n / 20) ** 2 / (n / 20)).sum() < 45
        assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03


def test_gamma_draws_have_the_right_moments():
    n = 40000
    for shape in (0.3, 1.0, 7.5):
        x = np.exp(R.np_log_gamma_draws(np.full(n, shape), np.arange(n), 1))
        assert abs(x.mean() - shape) < 5 * math.sqrt(shape / n)
        assert abs(x.var() - shape) < 0.1 * shape + 0.05
    tiny = R.np_log_gamma_draws(np.full(10, 1e-8), np.arange(10), 1)
    assert np.isfinite(tiny).all()


def test_half_a_hash_tells_where_a_uniform_may_exceed():
    u = R.np_uniform(np.arange(50000), 3, 4)
    for level in (0.0, 0.25, 0.9, 1 - 2.0**-27):
        may = R.np_may_exceed(np.arange(50000), level, 3, 4)
        assert may[u > level].all() and (u[may] > level - 2.0**-26).all()


def test_rows_of_numbers_exceed_where_single_ones_may(monkeypatch):
    """In pieces, across the lower half's end and beyond it."""
    monkeypatch.setattr(R, "CACHED_CELLS", 500)
    for start in (0, 2**32 - 3000, 2**40):
        for width in (1, 64, 1000):
            first = start + np.arange(40) * width
            numbers = first[:, None] + np.arange(width)
            for level in (0.0, 0.25, 0.998, 1 - 2.0**-27, 1.0):
                want = np.flatnonzero(R.np_may_exceed(numbers.ravel(), level, 3, 4))
                assert np.array_equal(R.np_exceeding(first, width, level, 3, 4), want)


def test_negligible_gamma_draws_are_below_all_others():
    lg = R.np_log_gamma_draws(np.full(20000, 1e-3), np.arange(20000), 1)
    u = np.log(R.np_uniform(np.arange(20000), 1, 0, 4)) / 1e-3
    tiny = u <= R.NEGLIGIBLE
    assert 0.8 < tiny.mean() < 0.95
    assert np.array_equal(lg[tiny], u[tiny]) and (lg[~tiny] != u[~tiny]).all()
