"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Queries on texts have tests of their own, where their subpackage is.
QUERIES = {name: run for name, run in entry.queries().items() if name in entry.QUERIES}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in entry.QUERIES}

# Rows drawn at random; source_sample_property says what holds for them.
WITHOUT_SQL = {"source_sample"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_only_these_have_no_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, name, QUERIES[name], SQL[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
