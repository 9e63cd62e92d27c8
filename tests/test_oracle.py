"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from graphloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    def cell(v):
        if isinstance(v, (list, dict)) or hasattr(v, "__len__") and not isinstance(v, str):
            return str(v)
        if pd.isna(v):
            return "null"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.7g}" if not math.isinf(float(v)) else str(v)
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
