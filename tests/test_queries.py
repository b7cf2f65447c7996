"""Registered queries against DuckDB over the same files; those without SQL must run and give their columns."""

import duckdb
import pytest

import __spark_entry__ as spec
from tools.check_queries import compare
from tunegauge.plans.registry import QUERIES
from tunegauge.sources.views import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(spec.oracle_sql()) <= set(spec.queries())


OWN = sorted(QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, con, name):
    message, good = compare(spark, con, name, SF_DIR)
    assert good, message


def test_entry_has_rows(spark):
    frame = spec.entry(spark)
    assert frame.count() == 3 and "mae" in frame.columns
