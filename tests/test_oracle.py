"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLE.get(name)) == ""


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_sql_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
