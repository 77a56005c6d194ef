"""Every corpus query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sparktab.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted("\x1f".join(map(cell, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
