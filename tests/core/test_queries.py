"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pandas as pd
import pytest

from sluice import registry

registry.load()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, str) or hasattr(v, "year"):
        return str(v)
    return f"{float(v):.6g}" if float(v) else "0"


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLES])
def test_equals_sql(spark, con, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())
