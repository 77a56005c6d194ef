"""Catalogue queries against their SQL on tables that are repeated with shifted keys."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab import catalogue
from sparktab.operators import anomaly, intervals, retrieval
from test_catalogue import DATA, plain

KEYS = {
    "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
}


def equal(spark, path, name, table_copies, rows=None):
    """The query's rows equal its SQL's; table_copies: how often each table it reads is repeated."""
    con = duckdb.connect()
    for t, copies in table_copies.items():
        shifted = ", ".join(f"{k} + i * 10000000 AS {k}" for k in KEYS[t])
        con.execute(f"COPY (SELECT * REPLACE ({shifted}) FROM (SELECT * FROM '{DATA}/{t}.parquet' LIMIT {rows or 10**9}), (SELECT UNNEST(range({copies})) AS i)) TO '{path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(path)).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert len(want) and plain(got) == plain(want)


@pytest.mark.parametrize("copies", [4, 12])
def test_outlier_factors_of_copies(spark, tmp_path, copies):
    # with 12 copies every row has k equal ones, and a density without bound
    equal(spark, tmp_path, "local_outlier_factor", {"part": copies})


def test_robust_covariance_of_copies(spark, tmp_path):
    equal(spark, tmp_path, "robust_covariance", {"orders": 8})  # beyond FEW rows


def test_a_concentration_step_is_an_aggregate_and_at_most_a_sketch(spark):
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 9000), rng.normal(6, 0.5, (3000, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "k long, x double, y double")
    context = spark.sparkContext
    context.setJobGroup("mcd", "robust covariance")
    fitted = anomaly.RobustCovariance(df, "k", ["x", "y"], 6)
    jobs = len(context.statusTracker().getJobIdsForGroup("mcd"))
    context.setLocalProperty("spark.jobGroup.id", None)
    # still: one more step by brute force changes nothing
    diff = rows - fitted.location
    nearest = np.argsort((diff @ np.linalg.inv(fitted.covariance) * diff).sum(1), kind="stable")[: fitted.h]
    assert np.allclose(rows[nearest].mean(0), fitted.location, atol=1e-10) and np.allclose(np.cov(rows[nearest].T, bias=True), fitted.covariance, atol=1e-10)
    assert len(fitted.determinants) > 5 and jobs <= 6 * len(fitted.determinants) + 30, (jobs, len(fitted.determinants))


def test_overlaps_of_copies(spark, tmp_path):
    equal(spark, tmp_path, "interval_overlap", {"orders": 3, "lineitem": 3})


@pytest.mark.parametrize("kind", ["double", "timestamp"])
def test_overlap_totals_equal_brute_force(spark, kind):
    rng = random.Random(11)
    odd = [(900, None, 3.0), (901, 5.0, None), (902, 7.0, 7.0), (903, 9.0, 2.0), (904, 0.0, 1e6)]
    side = lambda n: [(i, s := float(rng.randint(0, 1000)), s + rng.choice([1.0, 5.0, 60.0, 4000.0])) for i in range(n)] + odd
    a, b = side(80), side(60)
    frame = lambda rows: spark.createDataFrame(rows, "k long, s double, e double").withColumns({c: F.col(c).cast(kind) for c in "se"})
    got = {r["k"]: (r["n"], float(r["total"]) / (1e6 if kind == "timestamp" else 1)) for r in intervals.overlap_totals(frame(a), frame(b), "s", "e", "s", "e").collect()}
    real = lambda r: r[1] is not None and r[2] is not None and r[1] < r[2]
    want = {}
    for x in filter(real, a):
        met = [min(x[2], y[2]) - max(x[1], y[1]) for y in filter(real, b) if x[1] < y[2] and y[1] < x[2]]
        if met:
            want[x[0]] = len(met), sum(met)
    assert got == want and len(want) > 60


def test_overlap_totals_make_no_pairs(spark):
    spans = spark.range(20_000).select("id", (F.col("id") % 10).cast("double").alias("s"), F.lit(1e6).alias("e"))
    met = intervals.overlap_totals(spans, spans, "s", "e", "s", "e")  # 400 million pairs
    r = met.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert (r["rows"], r["n"]) == (20_000, 400_000_000)


def test_vector_context_of_copies(spark, tmp_path):
    equal(spark, tmp_path, "context_vectorsearch", {"supplier": 2, "customer": 7})


@pytest.mark.parametrize(("dense", "measure"), [(0, "cosine"), (10**9, "cosine"), (0, "jaccard"), (10**9, "jaccard")])
def test_tiles_and_joins_find_the_same_rows(spark, monkeypatch, dense, measure):
    for name, value in (("DENSE", dense), ("TILE_POSTINGS", 500), ("TILE_QUERIES", 7)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(12)
    texts = lambda n: [(i, "".join(rng.choice("abc0 ") for _ in range(rng.randint(1, 25)))) for i in range(n)]
    rows, asked = texts(150) + [(None, "abcabc"), (500, None), (501, "abcabc"), (502, "abcabc")], texts(40) + [(90, "zzzz")]
    found = retrieval.Retrieval(spark.createDataFrame(asked, "k long, t string"), spark.createDataFrame(rows, "k long, t string"), "k", "t", "k", "t", 4, 3, measure, retrieval.BUCKETS if measure == "cosine" else None)
    assert found.needed.where("dense").isEmpty() == (dense == 0)
    counts = lambda t: Counter(t[i : i + 3] for i in range(len(t) - 2))
    want = []
    for k, t in asked:
        a, scored = counts(t), []
        for j, u in rows:
            b = counts(u or "")
            common = sum(a[g] * b[g] for g in a) if measure == "cosine" else len(a.keys() & b.keys())
            if common:
                share = common / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if measure == "cosine" else common / len(a.keys() | b.keys())
                scored.append((-round(share, 9), -1 if j is None else j, common))
        want += [(k, j, common, -s) for s, j, common in sorted(scored)[:4]]
    got = [(r["query"], -1 if r["key"] is None else r["key"], r["common"], r["score"]) for r in found.best().collect()]
    assert sorted(got) == [pytest.approx(x, abs=2e-9) for x in sorted(want)] and len(want) > 120


def test_frequent_ngrams_are_not_shuffled_for_each_pair(spark):
    names = lambda kind, n: spark.range(n).select(F.col("id").alias("k"), F.format_string(kind + "#%09d", "id").alias("t"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return store.executorList(True).apply(0).totalShuffleWrite()

    before = written()
    found = retrieval.vector_context(names("Supplier", 100), names("Customer", 2000), "vectorsearch::5", "k", "k", ["t"]).collect()
    assert len(found) == 500 and written() - before < 8_000_000
