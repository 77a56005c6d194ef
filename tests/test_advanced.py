"""Anomaly scores, retrieval, resampling, stacking, intervals, folds and source order against brute-force versions."""

import hashlib
import itertools
import json
import math
import random
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.catalogue import modelling
from sparktab.functions.columns import row_digest
from sparktab.operators import anomaly, intervals, resample, retrieval, sketches, smoothing, splits, stacking
from sparktab.plans import preflight
from sparktab.sources import order, readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# anomaly


def test_isolation_scores_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(900, 9.0, 9.0), (901, None, 1.0), (902, float("nan"), 1.0), (903, float("inf"), 1.0)]
    got = {r["k"]: r["isolation_score"] for r in anomaly.isolation_scores(frame(spark, rows, "k long, x double, y double"), "k", ["x", "y"], 40, 64).collect()}
    assert got[901] is got[902] is got[903] is None
    assert got[900] == max(v for v in got.values() if v is not None) > 0.6
    one = anomaly.isolation_scores(frame(spark, [(1, 1.0)], "k long, x double"), "k", ["x"], 5, 8).collect()
    assert len(one) == 1 and one[0]["isolation_score"] is None  # nothing to be told from
    assert anomaly.isolation_scores(frame(spark, [], "k long, x double"), "k", ["x"], 5, 8).count() == 0


def lof_by_brute_force(points, k):
    n = len(points)
    d = [[math.dist(a, b) for b in points] for a in points]
    kth = [sorted(d[i][j] for j in range(n) if j != i)[k - 1] for i in range(n)]
    near = [[j for j in range(n) if j != i and d[i][j] <= kth[i]] for i in range(n)]
    reach = [sum(max(kth[j], d[i][j]) for j in near[i]) for i in range(n)]
    lrd = [len(near[i]) / reach[i] if reach[i] > 0 else math.inf for i in range(n)]
    return [1.0 if lrd[i] == math.inf else sum(lrd[j] for j in near[i]) / len(near[i]) / lrd[i] for i in range(n)]


@pytest.mark.parametrize("cell_rows", [8, 256])
def test_outlier_factors_equal_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(anomaly, "CELL_ROWS", cell_rows)  # many cells, or one
    rng = random.Random(2)
    points = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(120)] + [(rng.gauss(8, 0.1), rng.gauss(8, 0.1)) for _ in range(40)] + [(4.0, 4.0)] * 3 + [(20.0, -3.0)]
    rows = [(i, *p) for i, p in enumerate(points)]
    df = frame(spark, rows + [(999, None, 1.0)], "k long, x double, y double")
    got = {r["k"]: r["lof"] for r in anomaly.local_outlier_factors(df, ["x", "y"], 6).collect()}
    assert got.pop(999) is None
    want = lof_by_brute_force(points, 6)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in range(len(points)))


def test_copies_are_one_point(spark):
    rows = [(i, 1.0) for i in range(3000)] + [(5000 + i, float(i)) for i in range(3, 30)]
    got = {r["k"]: r["lof"] for r in anomaly.local_outlier_factors(frame(spark, rows, "k long, x double"), ["x"], 5).collect()}
    assert len(got) == len(rows) and got[0] == 1.0  # a density without bound
    near = anomaly.neighbours(frame(spark, rows, "k long, x double").groupBy(F.array("x").alias("x")).agg(F.count("*").alias("m")), 5)
    assert near.count() < 28 * 12


def test_neighbours_meet_by_cells(spark):
    points = spark.range(500).select(F.array((F.col("id") % 37).cast("double"), (F.col("id") % 41).cast("double")).alias("x"), F.lit(1).cast("long").alias("m"))
    plan = anomaly.neighbours(points, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (c#" in plan
    assert all("first" in line or "pivots" in line or "tops" in line or "(" in line for line in plan.splitlines() if "Join Cross" in line)


def test_robust_covariance_finds_the_clean_half(spark):
    rng = np.random.default_rng(3)
    clean = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 140)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.vstack([clean, rng.normal(9, 0.3, (60, 2))]))]
    df = frame(spark, rows, "k long, x double, y double")
    fitted = anomaly.RobustCovariance(df, "k", ["x", "y"], 40)
    drops = np.diff(fitted.determinants)
    assert (drops <= 1e-9).all() and np.abs(fitted.location).max() < 0.6
    # further starts reach no subset of a much smaller determinant
    data = np.array([r[1:] for r in rows])
    best = math.inf
    for s in range(60):
        keep = np.random.default_rng(s).choice(200, 3, replace=False)
        for _ in range(30):
            mean, cov = data[keep].mean(0), np.cov(data[keep].T, bias=True)
            if np.linalg.det(cov) < 1e-12:
                break
            diff = data - mean
            keep = np.argsort((diff @ np.linalg.inv(cov) * diff).sum(1), kind="stable")[: fitted.h]
            best = min(best, np.linalg.det(np.cov(data[keep].T, bias=True)))
    assert fitted.determinants[-1] <= best * 1.005
    far = {r["k"]: r["robust_distance"] for r in fitted.distances(df.union(frame(spark, [(999, None, 1.0)], "k long, x double, y double"))).collect()}
    assert far[999] is None and min(far[i] for i in range(140, 200)) > max(far[i] for i in range(140)) * 0.9
    flat = frame(spark, [(i, 1.0, float(i)) for i in range(20)], "k long, x double, y double")
    assert {r["robust_distance"] for r in anomaly.RobustCovariance(flat, "k", ["x", "y"]).distances(flat).collect()} == {None}


# retrieval


def grams(text, n=3):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def texts(rng, n):
    words = ["the", "and", "alpha", "beta", "gamma", "delta", "of", "to", "river", "stone"]
    return [" ".join(rng.choice(words) + str(rng.randint(0, 30) if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_retrieval_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(texts(rng, 120))] + [(900 + i, "the same text of many rows") for i in range(40)] + [(800, None), (801, "ab")]
    asked = [(i, t) for i, t in enumerate(texts(rng, 30))] + [(50, "The Same text of many rows"), (51, None), (52, "zzzzqqqq")]
    got = retrieval.ngram_retrieval(frame(spark, asked, "q long, t string"), frame(spark, rows, "k long, t string"), "k", "t", "q", "t", 4).collect()
    want = []
    for q, t in asked:
        if t and len(t) >= 3:
            scored = []
            for k, u in rows:
                if u and len(u) >= 3 and (common := len(grams(t.lower()) & grams(u.lower()))):
                    scored.append((-round(common / len(grams(t.lower()) | grams(u.lower())), 9), k, common))
            want += [(q, k, c, -s) for s, k, c in sorted(scored)[:4]]
    assert sorted((r["query"], r["key"], r["common"], round(r["jaccard"], 9)) for r in got) == sorted(want)


def test_retrieval_grows_with_the_table_not_its_square(spark):
    def pairs(n):
        df = frame(spark, [(i, t + " " + hashlib.md5(str(i).encode()).hexdigest()) for i, t in enumerate(texts(random.Random(5), n))], "k long, t string")
        return retrieval.Retrieval(df, df, "k", "t", "k", "t", 1).pairs.count()

    assert pairs(400) < 3 * pairs(200)


def test_context_must_be_smaller_than_its_candidates(spark):
    df = frame(spark, [(i, f"name {i}") for i in range(5)], "k long, name string")
    for strategy in ("vectorsearch::5", "vectorsearch::0", "vectorsearch", "other::2"):
        with pytest.raises(ValueError):
            retrieval.vector_context(df, df, strategy, "k", "k", ["name"])
    with pytest.raises(ValueError):
        retrieval.context(df, "random::5", ["k"])
    assert retrieval.vector_context(df, df, "vectorsearch::2", "k", "k", ["name"]).count() == 10


# resampling


def test_queue_interval_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, f"b{i % 24:02d}", i % 24 // 2, rng.choice("abcdefgh") if i % 3 else "hot", int(rng.random() < 0.3), rng.random(), None if i % 50 == 0 else rng.random()) for i in range(900)]
    df = frame(spark, rows, "k long, batch string, period int, entity string, y int, s double, o double")
    boot = resample.QueueBootstrap(df, "batch", F.col("period"), "entity", "k", "y", ("s", "o"), 6, 2, 60)
    draws = {r["replicate"]: (r["a"], r["b"], r["difference"]) for r in boot.draws().collect()}
    weights = {(kind, unit, i): w for kind, unit, i, w in frame(spark, [(kind, str(u), i) for kind, units in (("entity", set("abcdefgh") | {"hot"}), ("period", range(12))) for u in units for i in range(60)], "kind string, unit string, i int").select("kind", "unit", "i", resample.poisson_weight(7, F.col("kind"), F.col("unit"), F.col("i")).alias("w")).collect()}

    def rate(column, weight, period_weight):
        hits = taken = 0
        for batch in sorted({r[1] for r in rows}):
            mine = sorted((r for r in rows if r[1] == batch and r[column] is not None), key=lambda r: (-r[column], r[0]))
            seen, room = {}, 6
            for r in mine:
                seen[r[3]] = seen.get(r[3], 0) + 1
                if seen[r[3]] <= 2:
                    w = min(room, weight(r[3]))
                    room -= w
                    hits, taken = hits + w * r[4] * period_weight(r[2]), taken + w * period_weight(r[2])
        return hits / taken if taken else None

    for i in (0, 7, 59):
        for j, column in enumerate((5, 6)):
            assert draws[i][j] == pytest.approx(rate(column, lambda e: weights["entity", e, i], lambda p: weights["period", str(p), i]))
    one = boot.interval().first()
    a, b = (rate(c, lambda e: 1, lambda p: 1) for c in (5, 6))
    diffs = np.array([d[2] for d in draws.values()])
    left = np.array([rate(6, lambda e: 1, lambda p, q=q: int(p != q)) - rate(5, lambda e: 1, lambda p, q=q: int(p != q)) for q in range(12)])
    m = left.mean() - left
    acceleration = (m**3).sum() / (6 * (m**2).sum() ** 1.5)
    assert (one["a"], one["b"], one["n_periods"]) == (pytest.approx(a), pytest.approx(b), 12)
    assert one["acceleration"] == pytest.approx(acceleration, abs=1e-9) and one["low"] == pytest.approx(np.quantile(diffs, 0.025))
    normal = NormalDist()
    z0 = normal.inv_cdf((diffs < b - a).mean())
    ends = [np.quantile(diffs, normal.cdf(z0 + (z0 + normal.inv_cdf(p)) / (1 - acceleration * (z0 + normal.inv_cdf(p))))) for p in (0.025, 0.975)]
    assert [one["bca_low"], one["bca_high"]] == pytest.approx(ends, abs=1e-9)


def test_a_short_prefix_is_extended(spark, monkeypatch):
    monkeypatch.setattr(resample, "AHEAD", 1)  # entities of weight 0 leave the first prefix short
    rows = [(i, "b", i, i % 2, float(-i)) for i in range(200)]
    df = frame(spark, rows, "k long, batch string, entity long, y int, s double")
    boot = resample.QueueBootstrap(df, "batch", F.lit(0), "entity", "k", "y", ("s", "s"), 20, 1, 10)
    assert all(r["taken"] == 20 for r in boot.sums.collect())


# stacking


def test_weights_meet_the_conditions_of_optimality():
    rng = np.random.default_rng(7)
    for _ in range(50):
        x = rng.normal(size=(60, 5)) + rng.normal(size=(60, 1))
        y = x @ rng.normal(size=5) + rng.normal(size=60)
        g, c = x.T @ x, x.T @ y
        w = stacking.nonnegative_least_squares(g, c)
        slack = g @ w - c
        assert (w >= 0).all() and (slack >= -1e-7).all() and np.abs(w * slack).max() < 1e-7
        best = min((float(v @ g @ v / 2 - c @ v) for k in range(6) for s in itertools.combinations(range(5), k) for v in [np.zeros(5)] if not s or (lambda v, s: v.__setitem__(list(s), np.linalg.solve(g[np.ix_(s, s)], c[list(s)])) or (v >= 0).all())(v, s)), default=0.0)
        assert float(w @ g @ w / 2 - c @ w) == pytest.approx(best, abs=1e-6)


def test_stack_of_models_that_never_saw_their_fold(spark):
    rng = random.Random(8)
    rows = [(i, i % 3, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(240)]
    df = frame(spark, rows, "k long, fold int, x double, z double").withColumn("y", (F.col("x") + F.col("z") * 0.3 > 0).cast("int"))
    matrix = stacking.out_of_fold_matrix(df, "y", ["x", "z"], "fold", 3, ["logistic", "forest"]).cache()
    assert matrix.count() == 240 and {"p_logistic", "p_forest"} <= set(matrix.columns)
    fitted = stacking.NonNegative(matrix, "y", ["p_logistic", "p_forest"], "fold")
    assert all(r["holds"] for r in fitted.conditions(df).collect()) and set(fitted.weights) == {-1, 0, 1, 2}
    logistic = stacking.RidgeLogistic(matrix, "y", ["p_logistic", "p_forest"], "fold", 3)
    scored = logistic.score(fitted.score(matrix, "a"), "b")
    assert scored.agg(F.avg(((F.col("b") > 0.5) == (F.col("y") == 1)).cast("int"))).first()[0] > 0.9
    # a row's own label can't move its score
    flipped = stacking.NonNegative(matrix.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y"))), "y", ["p_logistic", "p_forest"], "fold")
    assert np.allclose(flipped.weights[0], fitted.weights[0]) and not np.allclose(flipped.weights[1], fitted.weights[1])


# intervals


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
def test_overlaps_equal_brute_force(spark, width):
    rng = random.Random(9)
    side = lambda n: [(i, rng.choice("ab"), s := rng.uniform(-50, 1000), s + rng.choice([0.1, 1, 5, 60, 4000])) for i in range(n)] + [(900, "a", None, 3.0), (901, "a", 5.0, None), (902, "a", 7.0, 7.0), (903, "a", 9.0, 2.0), (904, "b", -1e6, 1e6)]
    a, b = side(80), side(60)
    schema = "k long, g string, s double, e double"
    got = intervals.overlap_join(frame(spark, a, schema), frame(spark, b, schema), "s", "e", "s", "e", width, [("g", "g")])
    assert got.columns == ["k", "g", "s", "e", "k_right", "g_right", "s_right", "e_right"]
    real = lambda r: r[2] is not None and r[3] is not None and r[2] < r[3]
    want = sorted((x[0], y[0]) for x in a for y in b if real(x) and real(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r["k"], r["k_right"]) for r in got.collect()) == want


def test_purged_folds_equal_brute_force(spark):
    rng = random.Random(10)
    rows = [(i, i // 50, s := i + rng.random(), s + rng.choice([0.5, 3, 20])) for i in range(200)] + [(900, 1, None, 4.0), (901, None, 3.0, 5.0), (902, 2, 8.0, 8.0)]
    got = {(r["k"], r["outer_fold"]): r["role"] for r in intervals.purged_folds(frame(spark, rows, "k long, fold int, s double, e double"), "fold", 4, "s", "e", 12.0).collect()}
    for k, fold, s, e in rows:
        for f in range(4):
            valid = [r for r in rows if r[1] == f and r[2] is not None and r[3] is not None and r[2] < r[3]]
            last = max(r[3] for r in valid)
            if fold == f:
                role = "validation"
            elif s is None or e is None or s >= e or any(s < r[3] and r[2] < e for r in valid):
                role = "purged"
            else:
                role = "embargoed" if last <= s < last + 12 else "train"
            assert got[k, f] == role


# folds and digests


def test_blank_classes_and_commas_are_classes(spark):
    rows = [("a", ""), ("a", "x"), ("a", "a"), ("b", "x"), ("b", "a"), ("c", "a,b"), ("c", "x"), ("c", ""), ("c", "a"), (None, "x"), ("a", None)] * 12
    df = frame(spark, rows, "fold string, y string")
    audit = {r["partition"]: (r["n_rows"], r["n_classes"], r["n_missing"]) for r in splits.fold_audit(df, "fold", "y").collect()}
    assert audit == {"a": (48, 3, 1), "b": (24, 2, 2), "c": (48, 4, 0), "(missing)": (12, 1, 3)}
    assert sorted(tuple(r) for r in splits.missing_classes(df, "fold", "y").collect()) == [("(missing)", ""), ("(missing)", "a"), ("(missing)", "a,b"), ("a", "a,b"), ("b", ""), ("b", "a,b")]
    only_blank = frame(spark, [("a", ""), ("a", "x"), ("b", "x")] * 12, "fold string, y string").withColumn("v", F.rand(1))
    report = preflight.preflight(only_blank, preflight.Request("y", "row", "now"))
    assert "fold_missing_classes" in {f["code"] for f in report["modeling_preflight"]["findings"]}
    assert {p["value"]: p["missing_classes"] for p in report["split_context"]["folds"][0]["partitions"]} == {"a": [], "b": [""]}


def test_fold_audit_names_the_missing_classes(spark, tmp_path):
    rows = [("a", ""), ("a", "x"), ("b", 'q"\\'), ("b", "x"), ("c", "a,b"), ("c", "x"), (None, "x"), ("a", None)]
    got = {r["partition"]: (r["n_missing"], r["missing_classes"]) for r in splits.fold_audit_by_name(frame(spark, rows, "fold string, y string"), "fold", "y").collect()}
    assert {k: (n, json.loads(v)) for k, (n, v) in got.items()} == {"a": (2, ["a,b", 'q"\\']), "b": (2, ["", "a,b"]), "c": (2, ["", 'q"\\']), "(missing)": (3, ["", "a,b", 'q"\\'])}
    events = frame(spark, [(u, kind) for u in range(12) for kind in ["view", "buy", "", "a,b"][: 1 + u % 4]], "user_id long, event_type string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    query = modelling.QUERIES["fold_audit"](spark, str(tmp_path))
    want = sorted(duck.sql(modelling.ORACLES["fold_audit"]).select(*query.columns).fetchall())
    assert sorted(tuple(r) for r in query.collect()) == want and {r[-1] for r in want} - {"[]"}


def test_many_classes_stay_out_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(preflight, "LISTED", 5)
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("y"), F.concat(F.lit("p"), F.col("id") % 40).alias("fold"), (F.col("id") % 7).alias("v"))
    report = preflight.preflight(df, preflight.Request("y", "row", "now", task="classification"))
    assert len(report["target"]["class_counts"]) == 5 and report["target"]["classes_omitted"] == 1495
    fold = report["split_context"]["folds"][0]
    assert len(fold["partitions"]) == 5 and fold["partitions_omitted"] == 35 and fold["partitions_missing_classes"] == 40


def test_digests_tell_rows_apart(spark):
    rows = [(None, "b"), ("\u0001", "b"), ("", "b"), ("-", "b"), ("a\u001fb", "c"), ("a", "b\u001fc"), ("1:a", None), (None, "1:a"), ("ab", "c"), ("a", "bc")]
    got = [r[0] for r in frame(spark, rows, "x string, y string").select(row_digest(["x", "y"])).collect()]
    assert len(set(got)) == len(rows)


# source order


def test_head_follows_the_source(spark, tmp_path):
    for part in (3, 1, 2, 0):
        spark.range(part * 100, part * 100 + 100).select("id", (F.col("id") * 3).alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"p.parquet/part={part}"))
        spark.range(part * 100, part * 100 + 100).coalesce(1).write.option("header", True).csv(str(tmp_path / f"t.csv/part={part}"))
    df = spark.read.parquet(str(tmp_path / "p.parquet"))
    assert sorted(r["id"] for r in order.head(df.drop("part"), 150).collect()) == list(range(150))
    assert {r["id"]: r["position"] for r in order.positioned(df).collect()} == {i: i for i in range(400)}
    assert sorted(r["id"] for r in readers.scan(spark, str(tmp_path / "p.parquet"), max_rows=250).collect()) == list(range(250))
    text = spark.read.option("header", True).schema("id long").csv(str(tmp_path / "t.csv"))
    assert sorted(r["id"] for r in order.head(text, 130).collect()) == list(range(130))
    assert order.head(spark.range(10), 3).count() == 3


# smoothing and sketches


@pytest.mark.parametrize("piece", [3, 64])
def test_smoothing_equals_the_recursion(spark, monkeypatch, piece):
    monkeypatch.setattr(smoothing, "PIECE", piece)
    rng = random.Random(11)
    rows = [("long", t, rng.gauss(10, 3)) for t in range(500)] + [("short", 0, 4.0), ("gap", 0, 1.0), ("gap", 1, None), ("gap", 2, 3.0), (None, 0, 1.0)]
    got = {(r["series"], r["at"], r["alpha"]): (r["forecast"], r["level"]) for r in smoothing.smoothed(frame(spark, rows, "g string, t int, y double").repartition(3), "g", ["t"], "y", [0.2, 0.95]).collect()}
    for series in ("long", "short", "gap"):
        for a in (0.2, 0.95):
            level = None
            for at, y in enumerate(y for g, _, y in rows if g == series and y is not None):
                forecast, level = level, y if level is None else a * y + (1 - a) * level
                assert got.pop((series, at, a)) == (forecast if forecast is None else pytest.approx(forecast), pytest.approx(level))
    assert not got
    with pytest.raises(ValueError):
        smoothing.smoothed(frame(spark, rows, "g string, t int, y double"), "g", ["t"], "y", [1.0])


def test_demand_of_a_series_without_any(spark):
    rows = [("none", t, 0.0) for t in range(5)] + [("some", t, 6.0 if t in (2, 5) else 0.0) for t in range(8)]
    got = {r["series"]: r for r in smoothing.croston(frame(spark, rows, "g string, t int, y double"), "g", ["t"], "y", 0.5).collect()}
    assert (got["none"]["n_demands"], got["none"]["forecast"], got["none"]["size"]) == (0, 0.0, None)
    assert (got["some"]["n"], got["some"]["n_demands"], got["some"]["size"], got["some"]["gap"], got["some"]["forecast"]) == (8, 2, 6.0, 3.0, 2.0)


def test_sketches_of_parts_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 5).alias("part"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 9 > 0, (F.col("id") * 7919 % 15_013).cast("double")).alias("v"), (F.col("id") % 4).cast("string").alias("label"))
    store = sketches.build(df, ["part", "g"], ["label"], ["v"])
    assert store.count() == 30
    for subset in (store, store.where("part < 2")):
        rows = df if subset is store else df.where("part < 2")
        answers = sketches.answer(subset)
        assert all(r["distinct_holds"] and r["quantiles_hold"] in (True, None) for r in sketches.measured(rows, answers, [], ["label"], ["v"]).collect())
        assert {r["column_name"]: (r["n"], r["is_approx"]) for r in answers.collect()} == {c: (rows.count(), True) for c in ("label", "v")}
