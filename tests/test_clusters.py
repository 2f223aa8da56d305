import numpy as np
import pytest

from phenospark.operators import kmeans as KM
from phenospark.operators import mixture as MX
from phenospark.operators import vectors as V


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.6, (80, 2)) for c in ((0, 0), (5, 0), (0, 6))])


def test_ties_go_to_the_lowest_centre(spark):
    got = KM.kmeans_assign(points(spark, [[0.0, 0.0]]), "v", np.array([[1.0, 0.0], [-1.0, 0.0]])).first()
    assert got["cluster"] == 0


def test_kmeans_step_moves_centres_to_means(spark, blobs):
    centers = blobs[[0, 90, 200]]
    step = KM.kmeans_step(points(spark, blobs), "v", centers)
    near = ((blobs[:, None] - centers) ** 2).sum(2).argmin(1)
    want = np.array([blobs[near == k].mean(0) for k in range(3)])
    np.testing.assert_allclose(V.collect_matrix(step, "cluster", "center"), want)


def test_a_centre_without_points_gives_no_row(spark):
    step = KM.kmeans_step(points(spark, [[0.0], [1.0]]), "v", np.array([[0.0], [99.0]]))
    assert [r["cluster"] for r in step.collect()] == [0]


def test_dimension_stats(spark, blobs):
    df = points(spark, blobs)
    np.testing.assert_allclose([r["mean"] for r in V.vector_mean(df, "v").orderBy("dim").collect()], blobs.mean(0))
    np.testing.assert_allclose([r["var"] for r in V.diag_covariance(df, "v").orderBy("dim").collect()], blobs.var(0))


def test_full_covariance_density(spark, blobs):
    cov = np.array([[2.0, 0.7], [0.7, 1.0]])
    model = MX.Mixture(np.array([1.0]), np.array([[1.0, 2.0]]), np.array([cov]))
    got = [r["logpdf"][0] for r in MX.gaussian_logpdf(points(spark, blobs), "v", model).orderBy("id").collect()]
    delta = blobs - [1.0, 2.0]
    want = -0.5 * (2 * np.log(2 * np.pi) + np.log(np.linalg.det(cov)) + (delta @ np.linalg.inv(cov) * delta).sum(1))
    np.testing.assert_allclose(got, want)


def test_singular_covariance_uses_its_range(blobs):
    direction = np.array([[1.0, 1.0], [1.0, 1.0]])
    model = MX.Mixture(np.array([1.0]), np.zeros((1, 2)), np.array([direction]))
    delta = blobs @ np.linalg.pinv(direction) * blobs
    want = -0.5 * (2 * np.log(2 * np.pi) + np.log(2.0) + delta.sum(1))
    np.testing.assert_allclose(model.log_density(blobs)[:, 0], want)
    with pytest.raises(ValueError):
        MX.Mixture(np.array([1.0]), np.zeros((1, 2)), np.zeros((1, 2, 2))).log_density(blobs)


def test_memberships_sum_to_one(spark, blobs):
    model = MX.Mixture(np.array([0.3, 0.7]), np.array([[0.0, 0.0], [500.0, 500.0]]), np.ones((2, 2)))
    rows = MX.gmm_responsibilities(points(spark, blobs), "v", model).collect()
    np.testing.assert_allclose([sum(r["resp"]) for r in rows], 1.0)


def test_em_raises_the_likelihood_and_finds_the_blobs(spark, blobs):
    df = points(spark, blobs)
    start = MX.gmm_init(df, "id", "v", k=3, seed=3)
    assert start.means.shape == (3, 2) and np.allclose(start.weights, 1 / 3)
    start = MX.Mixture(np.full(3, 1 / 3), blobs[[0, 90, 200]], np.ones((3, 2)))
    model, history = MX.gmm_fit_diagonal(df, "v", start)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    centres = sorted(map(tuple, np.round(model.means).astype(int)))
    assert centres == [(0, 0), (0, 6), (5, 0)]
    np.testing.assert_allclose(model.weights, 1 / 3, atol=0.02)


def test_draws_are_repeatable_and_may_repeat_rows(spark, blobs):
    df = points(spark, blobs[:4])
    one = sorted(map(str, MX.seed_components(df, "id", "v", 2, seed=1).collect()))
    two = sorted(map(str, MX.seed_components(df, "id", "v", 2, seed=1).collect()))
    assert one == two and len(one) == 10
