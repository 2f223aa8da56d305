"""Every named query with SQL gives the rows of that SQL."""

import functools

import pytest

from compare import connect, differences
from phenospark.operators import joins
from phenospark.plans import catalog
from phenospark.plans.catalog import QUERIES
from phenospark.plans.oracle import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    found = differences(QUERIES[name](spark, FOLDER), duck, ORACLE_SQL[name])
    assert not [d for d in found if not d.startswith("note")]


@pytest.mark.parametrize("name", ["visit_pairs", "tensor_bag", "decode_triplets", "scaled_features", "frozen_sweep", "blocked_sweep", "ncp_reconstruct"])
def test_same_rows_when_nothing_may_be_broadcast(spark, duck, monkeypatch, name):
    """Every size check fails, so the salted joins do the work."""
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(catalog, "_prepared", {})
    found = differences(QUERIES[name](spark, FOLDER), duck, ORACLE_SQL[name])
    assert not [d for d in found if not d.startswith("note")]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, monkeypatch, name):
    # the registered fits run to their end, which takes minutes; where they stop changes nothing here
    monkeypatch.setattr(catalog.G, "fit_phenotypes", functools.partial(catalog.G.fit_phenotypes, sweeps=6))
    monkeypatch.setattr(catalog.N, "ncp_fit", functools.partial(catalog.N.ncp_fit, iterations=3))
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
