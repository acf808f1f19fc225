"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as registered
from tests.compare import compare, open_duckdb

FOLDER = os.environ.get("EFFORTLOOM_TABLES", "/root/testdata/sf0.001")
QUERIES, ORACLES = registered.queries(), registered.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1
