"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import pytest
from check_oracle import compare, connect
from conftest import SMALL

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    diff, _n = compare(entry.queries()[name](spark, SMALL), con, SQL[name])
    assert diff is None


def test_entry(spark):
    r = entry.entry(spark).collect()
    assert len(r) == 1 and 0 <= r[0]["base_rate"] <= 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
