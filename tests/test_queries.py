"""Queries against their SQL on the smallest tables."""

import pytest
from oracle import assert_same, connect

from pairloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df())
