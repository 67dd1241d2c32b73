"""Every query of the catalogue against its SQL in DuckDB, at the smallest size."""

import os
from decimal import Decimal

import duckdb
import pytest

from odata_spark import catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{float(r[i]):.6f}" if isinstance(r[i], (float, Decimal)) else str(r[i]) for i in order) for r in found)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, FOLDER), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.collect(), df.columns) == rows(sql.fetchall(), sql.columns)


def test_pushdown(spark):
    df = QUERIES["filter_range_and"](spark, FOLDER)
    assert "GreaterThanOrEqual(o_totalprice" in df._jdf.queryExecution().toString()
    assert "LeftAnti" in QUERIES["all_1n"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_children_of_a_page(spark):
    """Only the children of the page's rows reach the window; the page's keys are broadcast."""
    plan = QUERIES["expand_page"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("row_number") :]
    assert "LeftSemi" in window and "rightHint=(strategy=broadcast)" in window
