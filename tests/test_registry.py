"""Every registered query against its SQL on DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as registry
from retail_help import SMALL
from tillcast.plans.oracle import ORACLE
from tillcast.plans.queries import QUERIES
from tools.check import compare, connect

SQL = dict(ORACLE)


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(registry.queries()) and set(SQL) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    want = duck.execute(SQL[name]).to_arrow_table()
    assert compare(got, want) is None


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0
