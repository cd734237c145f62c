"""Registered queries equal their SQL twins; those of the corpus folder are compared in its own tests."""

import duckdb
import pytest

import __spark_entry__ as registry
import suite
from check_oracle import TABLES, compare

OWN = suite.all_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(OWN))
def test_query_equals_sql(spark, sf_dir, con, name):
    message, good = compare(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql().get(name))
    assert good, message


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(OWN) == set(suite.all_sql())


def test_entry(spark):
    assert registry.entry(spark).count() == 4
