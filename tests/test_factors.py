import numpy as np
import pytest

from phenospark.operators import ncp as N


def tensor(spark, x):
    cells = [(int(i), int(j), int(k), float(x[i, j, k])) for i, j, k in np.argwhere(x > 0)]
    return spark.createDataFrame(cells, "patient long, diag long, med long, value double")


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(1)
    a, b, c = (rng.random((n, 2)) * (rng.random((n, 2)) < 0.5) for n in (12, 5, 6))
    return np.einsum("ir,jr,kr->ijk", a, b, c)


def dense(factors, mode):
    rows = sorted(factors.tables[mode].select("idx", "f").collect())
    return np.array([r["f"] for r in rows])


def test_one_update_is_the_published_rule(spark, planted):
    dims = dict(zip(("patient", "diag", "med"), planted.shape))
    start = N.initial_factors(spark, dims, 3, seed=2)
    a, b, c = (dense(start, m) for m in dims)
    num = np.einsum("ijk,ir,jr->kr", planted, a, b)
    want = c * num / (c @ ((a.T @ a) * (b.T @ b)) + N.FLOOR)
    for limit in (None, 0):
        got = N.ncp_step(tensor(spark, planted), start, "med", limit=limit)
        np.testing.assert_allclose([r["f"] for r in sorted(got.select("idx", "f").collect())], want)


def test_error_falls_and_matches_the_dense_one(spark, planted):
    dims = dict(zip(("patient", "diag", "med"), planted.shape))
    factors, errors = N.ncp_fit(tensor(spark, planted), dims, rank=2, iterations=4, tol=0)
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    model = np.einsum("ir,jr,kr->ijk", *(dense(factors, m) for m in dims))
    assert abs(((planted - model) ** 2).sum() - errors[-1]) < 1e-8
    far, same = N.ncp_fit(tensor(spark, planted), dims, rank=2, iterations=4, tol=0, limit=0)
    np.testing.assert_allclose(same, errors)
    unit, weights = N.normalised(factors)
    again = np.einsum("r,ir,jr,kr->ijk", weights, *(dense(unit, m) for m in dims))
    np.testing.assert_allclose(again, model, atol=1e-12)


def test_matrix_as_two_modes(spark):
    x = np.zeros((6, 6))
    x[:3, :3] = 1
    x[3:, 3:] = 1
    cells = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "row long, col long, value double")
    factors, _ = N.ncp_fit(cells, {"row": 6, "col": 6}, rank=2, iterations=12, tol=0)
    rows = N.ncp_mask(cells, factors).collect()
    assert len(rows) == 36
    assert all(r["mask"] == r["value"] for r in rows)
    assert max(r["scaled"] for r in rows) == 1.0


@pytest.mark.parametrize("order", [("patient", "diag", "med"), ("med", "patient", "diag"), ("diag", "med", "patient")])
def test_one_pass_per_iteration_is_the_same_fit(spark, planted, monkeypatch, order):
    """The long mode first, between and last; values without entries; past a write of the factors."""
    dims = dict(zip(("patient", "diag", "med"), planted.shape)) | {"patient": planted.shape[0] + 3}
    dims = {m: dims[m] for m in order}
    monkeypatch.setattr(N, "REPLAY", 2)
    cells = tensor(spark, planted)
    cells = cells.unionByName(spark.createDataFrame([(0, None, 1, 1.0)], cells.schema))
    far, want = N.ncp_fit(cells, dims, rank=2, iterations=5, tol=0, limit=0)
    steps = []
    monkeypatch.setattr(N, "ncp_step", lambda *a, **k: steps.append(a))
    near, got = N.ncp_fit(cells, dims, rank=2, iterations=5, tol=0)
    assert not steps
    np.testing.assert_allclose(got, want)
    assert near.modes == far.modes
    for m in dims:
        np.testing.assert_allclose(dense(near, m), dense(far, m), atol=1e-12)
