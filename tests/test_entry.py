"""The driver contract: queries run and agree with DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from structlens.plans import benchmark, sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df):
    names = sorted(df.columns)
    value = lambda v: None if pd.isna(v) else round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(value, r)) for r in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", list(benchmark.QUERIES))
def test_query(spark, tables, name):
    got = benchmark.QUERIES[name](spark, SF).toPandas()
    if name in sql.SQL:
        expected = tables.sql(sql.SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns) and rows(got) == rows(expected)
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
