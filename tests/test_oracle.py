"""Every registered query with SQL against DuckDB on the smallest tables
(the driver does the same at sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from tests_oracle_support import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], SQL[name], SF)
    assert r["ok"], r


def test_every_query_registered_has_callable():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "text", "label", "split"]
    assert df.count() > 0
