"""Every query with SQL against DuckDB, on the smallest data folder."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from conftest import DATA

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "strftime"):
        return pd.Timestamp(v).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, (int, float)):
        return f"{float(v):.6f}"
    return str(v)


def _table(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_value(v) for v in r) for r in df.itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, DATA).toPandas()
    theirs = duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _table(ours) == _table(theirs)


@pytest.mark.parametrize("name", ["schema_overview", "sample_customers", "isolation_forest"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 3
