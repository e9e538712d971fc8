"""Every query next to its DuckDB SQL, whole tables, smallest scale."""

import pytest
from check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name))
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
