"""Every registered query against its SQL on the smallest data."""

import __spark_entry__ as entry
import pytest
from harness import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    ok, text = compare(spark, con, sf, name, QUERIES[name], SQL.get(name))
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "n"]


def test_sql_has_no_unknown_names():
    assert set(SQL) <= set(QUERIES)
