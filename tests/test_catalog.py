"""The registered queries against DuckDB, and what their plans may not contain."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare
from wattline.catalog.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    for table in TABLES.split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    _, text, same = compare(spark, con, name, SF)
    assert same, text


@pytest.mark.parametrize(
    "name", ["outlier_flags", "build_features", "rolling_origin", "backtest_ridge", "forecast_horizon"]
)
def test_no_cross_joins(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry_has_rows(spark, con):
    assert entry.entry(spark).count() > 0
