"""Every registered query against its oracle, or against its row count, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suite.check import compare, connect
from suite.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "memory_id", "score"]
