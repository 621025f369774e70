"""Every registered query with SQL gives the rows of its SQL; the others give stable columns."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows_of_spark, rows_of_sql

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, tiny, con):
    assert rows_of_spark(QUERIES[name](spark, tiny)) == rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, tiny):
    df = QUERIES[name](spark, tiny)
    assert df.columns
    assert df.limit(5).collect() is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
