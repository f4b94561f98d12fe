"""Every registered query against its SQL twin on the small tables; the others must return rows."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"risk_halts"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, _, message = compare(spark, SF, name, QUERIES[name], SQL.get(name), con)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
