"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sparktab import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and pd.notna(v) else cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_benchmark_item_is_a_query(spark, duck):
    got = {r["query"] for r in catalogue.QUERIES["char_ngram_retrieval"](spark, DATA).select("query").distinct().collect()}
    want = {i for (i,) in duck.sql("SELECT item_id FROM benchmark WHERE length(text) >= 3").fetchall()}
    assert got == want and len(want) > 20
