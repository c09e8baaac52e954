"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from compare import compare, oracle
from wayline.plans import landmarks, network, problems, rasters, sequences, stores, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = (problems, sequences, landmarks, network, rasters, stores, views)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return oracle(SF)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    line, ok, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, line


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
