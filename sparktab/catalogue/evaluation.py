"""Metrics, uncertainty, drift and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import queue as Q
from ..operators import resample as B
from ..operators import smoothing as H
from ..operators import stacking as K
from .base import Registry, rounded, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

# a formulaic score for tests: no model is behind it
_SCORED = "(SELECT doc_id, toxic, quality, ((doc_id * 37) % 101) / 100.0 * 0.7 + toxic * 0.25 AS score FROM labels)"


def _scored(spark, d):
    return table(spark, d, "labels").withColumn("score", ((F.col("doc_id") * 37) % 101) / F.lit(100.0) * 0.7 + F.col("toxic") * 0.25)


@R.add(f"""
WITH s AS (SELECT toxic AS y, CAST(score >= 0.5 AS INTEGER) AS p FROM {_SCORED}), k AS (SELECT UNNEST([0, 1]) AS label),
c AS (SELECT label, COUNT(*) FILTER (WHERE y = label) AS support, COUNT(*) FILTER (WHERE p = label) AS np, COUNT(*) FILTER (WHERE y = label AND p = label) AS hit FROM s, k GROUP BY label)
SELECT label, support, ROUND(COALESCE(hit / nullif(np, 0), 0), 6) AS precision, ROUND(COALESCE(hit / nullif(support, 0), 0), 6) AS recall, ROUND(COALESCE(2 * hit / nullif(np + support, 0), 0), 6) AS f1 FROM c
""")
def classification_metrics(spark, d):
    return rounded(M.classification_metrics(_scored(spark, d).withColumn("p", (F.col("score") >= 0.5).cast("int")), "toxic", "p"))


@R.add(f"SELECT COUNT(*) AS n, ROUND(AVG(CAST(toxic = CAST(score >= 0.5 AS INTEGER) AS DOUBLE)), 6) AS accuracy FROM {_SCORED}")
def accuracy(spark, d):
    return rounded(M.accuracy(_scored(spark, d).withColumn("p", (F.col("score") >= 0.5).cast("int")), "toxic", "p").drop("macro_f1"))


@R.add(f"""
WITH s AS (SELECT toxic AS y, score FROM {_SCORED})
SELECT (SELECT COUNT(*) FROM s WHERE y = 1) AS n_positive, (SELECT COUNT(*) FROM s WHERE y = 0) AS n_negative,
  ROUND(AVG(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM s a, s b WHERE a.y = 1 AND b.y = 0
""")
def roc_auc(spark, d):
    return rounded(M.roc_auc(_scored(spark, d), "toxic", "score"))


@R.add(f"""
WITH g AS (SELECT score, SUM(toxic) AS p, COUNT(*) AS n FROM {_SCORED} GROUP BY 1), c AS (SELECT p, SUM(p) OVER w AS hits, SUM(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC))
SELECT CAST(SUM(p) AS BIGINT) AS n_positive, ROUND(SUM(p * hits / seen) / SUM(p), 6) AS average_precision FROM c
""")
def pr_auc(spark, d):
    return rounded(M.average_precision(_scored(spark, d), "toxic", "score"))


@R.add(f"""
WITH g AS (SELECT score AS threshold, SUM(toxic) AS p, COUNT(*) AS k FROM {_SCORED} GROUP BY 1),
c AS (SELECT threshold, SUM(k) OVER w AS n, SUM(p) OVER w AS hits FROM g WINDOW w AS (ORDER BY threshold DESC)), t AS (SELECT SUM(p) AS p, SUM(k) AS k FROM g)
SELECT ROUND(threshold, 6) AS threshold, CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, CAST(n - hits AS BIGINT) AS misses, ROUND(hits / t.p, 6) AS recall, ROUND((n - hits) / (t.k - t.p), 6) AS false_positive_rate,
  ROUND(hits / n, 6) AS precision, ROUND((hits / n) / (t.p / t.k), 6) AS lift FROM c, t
""")
def score_curve(spark, d):
    return rounded(M.score_curve(_scored(spark, d), "toxic", "score"))


@R.add(f"""
SELECT CAST(LEAST(floor(score * 10), 9) AS INTEGER) AS bin, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean_score, ROUND(AVG(toxic), 6) AS observed, ROUND(abs(AVG(score) - AVG(toxic)), 6) AS gap FROM {_SCORED} GROUP BY 1
""")
def calibration_bins(spark, d):
    return rounded(M.calibration_bins(_scored(spark, d), "toxic", "score"))


@R.add(f"SELECT ROUND(SUM(n * gap) / SUM(n), 6) AS ece FROM (SELECT COUNT(*) AS n, abs(AVG(score) - AVG(toxic)) AS gap FROM {_SCORED} GROUP BY LEAST(floor(score * 10), 9))")
def calibration_error(spark, d):
    return rounded(M.calibration_error(_scored(spark, d), "toxic", "score"))


@R.add(f"""
SELECT COUNT(*) AS n, ROUND(AVG(-(toxic * ln(p) + (1 - toxic) * ln(1 - p))), 6) AS log_loss, ROUND(AVG((score - toxic) * (score - toxic)), 6) AS brier FROM (SELECT *, GREATEST(1e-15, LEAST(1 - 1e-15, score)) AS p FROM {_SCORED})
""")
def log_loss_brier(spark, d):
    return rounded(M.probability_scores(_scored(spark, d), "toxic", "score"))


_PRICE = "(SELECT l_extendedprice AS y, l_quantity * 1000.0 AS p FROM lineitem)"


@R.add(f"""
SELECT COUNT(*) AS n, ROUND(AVG(abs(p - y)), 4) AS mae, ROUND(sqrt(AVG((p - y) * (p - y))), 4) AS rmse, ROUND(median(abs(p - y)), 4) AS median_ae,
  ROUND(1 - SUM((p - y) * (p - y)) / (var_pop(y) * COUNT(*)), 4) AS r2, ROUND(sqrt(AVG(pow(ln(1 + p) - ln(1 + y), 2))), 4) AS rmsle, ROUND(AVG(abs((p - y) / nullif(y, 0))), 4) AS mape FROM {_PRICE}
""")
def regression_metrics(spark, d):
    return rounded(M.regression_metrics(table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1000.0), "l_extendedprice", "p"), 4)


@R.add("""
WITH r AS (SELECT user_id AS e, value AS y, LAG(value, 2) OVER w AS f, LAG(value, 1) OVER w AS one FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT e, COUNT(f) AS n, AVG(abs(y - f)) AS mae, AVG(pow(y - f, 2)) AS mse, AVG(abs(y - one)) AS scale, AVG(pow(y - one, 2)) AS scale2, AVG(COALESCE(2 * abs(y - f) / nullif(abs(y) + abs(f), 0), CASE WHEN f IS NOT NULL THEN 0.0 END)) AS smape FROM r GROUP BY 1)
SELECT CAST(SUM(n) AS BIGINT) AS n, ROUND(AVG(mae / nullif(scale, 0)), 6) AS mase, ROUND(AVG(sqrt(mse / nullif(scale2, 0))), 6) AS rmsse, ROUND(AVG(smape), 6) AS smape FROM p
""")
def mase_smape(spark, d):
    return rounded(M.forecast_metrics(table(spark, d, "events"), "user_id", "ts", "event_id", "value", 2))


@R.add("""
SELECT COUNT(*) AS n, ROUND(AVG(CAST(o_totalprice BETWEEN 50000 AND 300000 AS DOUBLE)), 6) AS coverage, 250000.0 AS mean_width,
  ROUND(AVG(CASE WHEN o_totalprice >= 50000 THEN (o_totalprice - 50000) * 0.1 ELSE (50000 - o_totalprice) * 0.9 END), 4) AS pinball_low,
  ROUND(AVG(CASE WHEN o_totalprice >= 300000 THEN (o_totalprice - 300000) * 0.9 ELSE (300000 - o_totalprice) * 0.1 END), 4) AS pinball_high FROM orders
""")
def pinball_coverage(spark, d):
    t = table(spark, d, "orders").withColumn("lo", F.lit(50000.0)).withColumn("hi", F.lit(300000.0))
    out = M.interval_metrics(t, "o_totalprice", "lo", "hi", 0.8)
    return out.select("n", F.round("coverage", 6).alias("coverage"), "mean_width", F.round("pinball_low", 4).alias("pinball_low"), F.round("pinball_high", 4).alias("pinball_high"))


@R.add("""
WITH e AS (SELECT l_returnflag AS a, l_linestatus AS b, l_discount AS e FROM lineitem)
SELECT NULL AS slice, NULL AS value, COUNT(*) AS n, ROUND(AVG(e), 9) AS mean_error FROM e UNION ALL SELECT 'l_returnflag', a, COUNT(*), ROUND(AVG(e), 9) FROM e GROUP BY a
UNION ALL SELECT 'l_linestatus', b, COUNT(*), ROUND(AVG(e), 9) FROM e GROUP BY b
""")
def slice_metrics(spark, d):
    return rounded(M.slice_metrics(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount")), 9)


@R.add("""
WITH p AS (SELECT CAST(user_id AS VARCHAR) AS c, SUM(value) AS s, COUNT(*) AS n FROM events GROUP BY 1), r AS (SELECT UNNEST(range(20)) AS replicate),
u AS (SELECT replicate, s, n, (CAST('0x' || substr(md5('7|' || c || '|' || replicate), 1, 8) AS BIGINT) % 1000000) / 1000000.0 AS u FROM p, r),
w AS (SELECT *, (CASE WHEN u >= 0.36787944 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.73575888 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.91969860 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.98101184 THEN 1 ELSE 0 END)
  + (CASE WHEN u >= 0.99634015 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.99940582 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.99991676 THEN 1 ELSE 0 END) AS w FROM u)
SELECT CAST(replicate AS INTEGER) AS replicate, CAST(SUM(w * n) AS BIGINT) AS weight, ROUND(SUM(w * s) / nullif(SUM(w * n), 0), 6) AS mean FROM w GROUP BY replicate
""")
def bootstrap_ci(spark, d):
    return rounded(M.bootstrap_mean(table(spark, d, "events"), "user_id", "value", 20))


@R.add("SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 4) AS total, ROUND(SUM(l_quantity) * SUM(l_quantity) / SUM(l_quantity * l_quantity), 4) AS ess FROM lineitem")
def effective_sample_size(spark, d):
    return rounded(M.effective_sample_size(table(spark, d, "lineitem"), "l_quantity"), 4)


def _drift_sql(columns: list[str]) -> str:
    one = """SELECT '{c}' AS column_name, ROUND(AVG({c}) FILTER (WHERE NOT b), 6) AS mean_a, ROUND(AVG({c}) FILTER (WHERE b), 6) AS mean_b,
ROUND((AVG({c}) FILTER (WHERE b) - AVG({c}) FILTER (WHERE NOT b)) / sqrt((var_samp({c}) FILTER (WHERE b) + var_samp({c}) FILTER (WHERE NOT b)) / 2), 6) AS smd,
CAST(0 AS BIGINT) AS missing_a, CAST(0 AS BIGINT) AS missing_b, COUNT(*) FILTER (WHERE b AND ({c} < (SELECT MIN({c}) FROM e WHERE NOT b) OR {c} > (SELECT MAX({c}) FROM e WHERE NOT b))) AS out_of_range FROM e"""
    return "WITH e AS (SELECT *, o_orderdate >= TIMESTAMP '1999-01-01' AS b FROM orders) " + " UNION ALL ".join(one.format(c=c) for c in columns)


@R.add(_drift_sql(["o_totalprice", "o_custkey"]))
def drift_smd(spark, d):
    return rounded(M.drift(table(spark, d, "orders"), F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"), ["o_totalprice", "o_custkey"]))


@R.add("SELECT l_partkey AS value, COUNT(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01') GROUP BY 1")
def unseen_categories(spark, d):
    t = table(spark, d, "lineitem")
    edge = lambda x: F.lit(x).cast("timestamp_ntz")
    return M.unseen_categories(t.where(F.col("l_shipdate") < edge("1996-01-01")), t.where(F.col("l_shipdate") >= edge("2000-01-01")), "l_partkey")


@R.add(f"SELECT COUNT(*) AS n, ROUND(AVG(CASE WHEN score >= 0.5 AND toxic = 0 THEN 1.0 WHEN score < 0.5 AND toxic = 1 THEN 5.0 ELSE 0.0 END), 6) AS expected_cost FROM {_SCORED}")
def expected_cost(spark, d):
    return rounded(M.expected_cost(_scored(spark, d).withColumn("p", (F.col("score") >= 0.5).cast("int")), "toxic", "p", 1.0, 5.0))


@R.add("SELECT COUNT(*) AS n_folds, ROUND(AVG(m), 6) AS mean, ROUND(stddev_samp(m), 6) AS std, ROUND(MIN(m), 6) AS min, ROUND(MAX(m), 6) AS max FROM (SELECT event_id % 5 AS f, AVG(value) AS m FROM events GROUP BY 1)")
def fold_variation(spark, d):
    return rounded(M.fold_variation(table(spark, d, "events").withColumn("fold", F.col("event_id") % 5), "fold", "value"))


@R.add("SELECT MIN(c_name) AS best_name, ANY_VALUE(c_acctbal) AS best_score FROM customer WHERE c_acctbal = (SELECT MAX(c_acctbal) FROM customer)")
def best_score(spark, d):
    return M.best_score(table(spark, d, "customer"), "c_name", "c_acctbal")


_QUEUE = "(SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)"


def _queue(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))


@R.add(f"""
WITH c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY day, user_id ORDER BY value DESC, event_id) AS e FROM {_QUEUE}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS queue_rank FROM c WHERE e <= 2)
SELECT event_id, day, CAST(queue_rank AS INTEGER) AS queue_rank FROM r WHERE queue_rank <= 20
""")
def select_queue_topk(spark, d):
    return Q.select_queue(_queue(spark, d), "day", "user_id", "value", "event_id", 20, 2).select("event_id", "day", "queue_rank")


@R.add(f"""
WITH r AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, ROW_NUMBER() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS r FROM {_QUEUE})
SELECT day AS batch, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives, CAST(SUM(CASE WHEN r <= 25 THEN y ELSE 0 END) AS BIGINT) AS hits, ROUND(SUM(CASE WHEN r <= 25 THEN y ELSE 0 END) / LEAST(25, COUNT(*)), 6) AS precision,
  ROUND(SUM(CASE WHEN r <= 25 THEN y ELSE 0 END) / nullif(SUM(y), 0), 6) AS recall, ROUND(SUM(CASE WHEN r <= 25 THEN y ELSE 0 END) / LEAST(25, COUNT(*)) / nullif(SUM(y) / COUNT(*), 0), 6) AS lift FROM r GROUP BY day
""")
def capacity_metrics(spark, d):
    t = _queue(spark, d).withColumn("y", (F.col("event_type") == "error").cast("int"))
    return rounded(Q.capacity_metrics(t, "day", "y", "value", "event_id", 25))


@R.add("""
WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 200)
SELECT 200 AS k, COUNT(*) AS n_common, ROUND(COUNT(*) / 200.0, 6) AS overlap FROM a JOIN b USING (p_partkey)
""")
def rank_overlap(spark, d):
    t = table(spark, d, "part")
    return rounded(Q.rank_overlap(t.withColumn("s", F.col("p_retailprice")), t.withColumn("s", F.col("p_size").cast("double")), "p_partkey", "s", 200))


@R.add("""
WITH r AS (SELECT RANK() OVER (ORDER BY p_retailprice) + (COUNT(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS x, RANK() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS y FROM part)
SELECT COUNT(*) AS n, ROUND(corr(x, y), 6) AS spearman FROM r
""")
def rank_stability(spark, d):
    return rounded(Q.rank_correlation(table(spark, d, "part"), "p_retailprice", "p_size"))


@R.add("SELECT COUNT(*) AS n_entities, ROUND(MAX(n) / SUM(n), 6) AS largest_share, ROUND(SUM(n * n) / (SUM(n) * SUM(n)), 6) AS hhi FROM (SELECT COUNT(*) AS n FROM events GROUP BY user_id)")
def queue_concentration(spark, d):
    return rounded(Q.concentration(table(spark, d, "events"), "user_id"))


@R.add("SELECT event_id, ROUND((value - m) / (1.4826 * (SELECT median(abs(value - (SELECT median(value) FROM events))) FROM events)), 6) AS robust_z FROM events, (SELECT median(value) AS m FROM events)")
def robust_zscore(spark, d):
    return rounded(Q.robust_zscore(table(spark, d, "events"), "value").select("event_id", "robust_z"))


@R.add("""
SELECT CAST(year(o_orderdate) AS INTEGER) AS vintage, COUNT(*) AS scored, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS matured,
  COUNT(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 90 DAY > TIMESTAMP '2000-06-01') AS pending, COUNT(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 90 DAY <= TIMESTAMP '2000-06-01') AS lost FROM orders GROUP BY 1
""")
def maturity_vintages(spark, d):
    t = table(spark, d, "orders").select(F.year("o_orderdate").alias("vintage"), F.col("o_orderkey").alias("s"), F.when(F.col("o_orderstatus") == "F", 1).alias("y"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("due"))
    return Q.maturity_counts(t, "vintage", "s", "y", "due", "2000-06-01")


@R.add("SELECT COUNT(*) AS n_paired, ROUND(AVG(value * 0.9) - AVG(value), 6) AS delta FROM events")
def ablation_delta(spark, d):
    e = table(spark, d, "events")
    return rounded(M.ablation_delta(e, e.withColumn("value", F.col("value") * 0.9), "event_id", "value"))


@R.add("""
WITH r AS (SELECT event_id AS k, user_id AS g, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value AS v FROM events), n AS (SELECT g, y, ROW_NUMBER() OVER (PARTITION BY g ORDER BY k) AS i FROM r),
d AS (SELECT g, v, b, ROW_NUMBER() OVER (PARTITION BY g, b ORDER BY md5('7|' || b || '|' || k), k) AS i FROM r, (SELECT UNNEST(range(1, 11)) AS b)),
s AS (SELECT b, AVG(v) FILTER (WHERE y = 1) - AVG(v) FILTER (WHERE y = 0) AS d FROM d JOIN n USING (g, i) GROUP BY b), x AS (SELECT COUNT(*) AS n, AVG(v) FILTER (WHERE y = 1) - AVG(v) FILTER (WHERE y = 0) AS difference FROM r)
SELECT n, ROUND(difference, 6) AS difference, ROUND((1 + COUNT(*) FILTER (WHERE abs(d) >= abs(difference))) / 11.0, 6) AS p_value FROM s, x GROUP BY ALL
""")
def permutation_test(spark, d):
    t = table(spark, d, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return rounded(M.permutation_test(t, "event_id", "user_id", "y", "value", 10))


@R.add("SELECT COUNT(*) AS n, ROUND(quantile_cont(value, 0.5), 6) AS median, ROUND(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def latency_summary(spark, d):
    return rounded(M.latency_summary(table(spark, d, "events"), "value"))


_CAPACITY, _REPLICATES = 12, 40


def _two_scores(spark, d):
    t = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    return t.withColumns({"y": (F.col("event_type") == "error").cast("int"), "other": F.col("value") + (F.col("event_id") * 37) % 11})


def _bootstrapped(spark, d):
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 3)
    return B.QueueBootstrap(_two_scores(spark, d), "day", week, "user_id", "event_id", "y", ("value", "other"), _CAPACITY, 2, _REPLICATES)


_WEIGHT = """(CASE WHEN u >= 0.36787944 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.73575888 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.91969860 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.98101184 THEN 1 ELSE 0 END)
  + (CASE WHEN u >= 0.99634015 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.99940582 THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.99991676 THEN 1 ELSE 0 END)"""
# every row of every batch in every replicate, without prefixes
_REPLAYED = f"""
WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / 3) AS BIGINT) AS period, user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
    UNNEST([0, 1]) AS score, UNNEST([value, value + (event_id * 37) % 11]) AS s FROM events),
c AS (SELECT * FROM e QUALIFY ROW_NUMBER() OVER (PARTITION BY score, day, user_id ORDER BY s DESC, event_id) <= 2),
x AS (SELECT *, (CAST('0x' || substr(md5('7|entity|' || user_id || '|' || replicate), 1, 8) AS BIGINT) % 1000000) / 1000000.0 AS u FROM c, (SELECT UNNEST(range(-1, {_REPLICATES})) AS replicate)),
w AS (SELECT *, CASE WHEN replicate < 0 THEN 1 ELSE {_WEIGHT} END AS w FROM x),
t AS (SELECT *, greatest(0, least(w, {_CAPACITY} - COALESCE(SUM(w) OVER (PARTITION BY score, replicate, day ORDER BY s DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM w),
b AS (SELECT score, replicate, period, SUM(taken) AS taken, SUM(taken * y) AS hits FROM t GROUP BY ALL),
p AS (SELECT *, CASE WHEN replicate < 0 THEN 1 ELSE {_WEIGHT} END AS w FROM (SELECT *, (CAST('0x' || substr(md5('7|period|' || period || '|' || replicate), 1, 8) AS BIGINT) % 1000000) / 1000000.0 AS u FROM b)),
d AS (SELECT replicate, SUM(w * hits) FILTER (WHERE score = 0) / nullif(SUM(w * taken) FILTER (WHERE score = 0), 0) AS a, SUM(w * hits) FILTER (WHERE score = 1) / nullif(SUM(w * taken) FILTER (WHERE score = 1), 0) AS b FROM p GROUP BY replicate)
"""


@R.add(_REPLAYED + "SELECT CAST(replicate AS INTEGER) AS replicate, ROUND(a, 6) AS a, ROUND(b, 6) AS b, ROUND(b - a, 6) AS difference FROM d WHERE replicate >= 0")
def queue_bootstrap(spark, d):
    return rounded(_bootstrapped(spark, d).draws())


@R.add(_REPLAYED + """,
l AS (SELECT x.period, SUM(CASE WHEN y.score = 1 THEN y.hits END) / nullif(SUM(CASE WHEN y.score = 1 THEN y.taken END), 0) - SUM(CASE WHEN y.score = 0 THEN y.hits END) / nullif(SUM(CASE WHEN y.score = 0 THEN y.taken END), 0) AS v
  FROM (SELECT DISTINCT period FROM b) x JOIN b y ON y.period <> x.period AND y.replicate < 0 GROUP BY x.period),
j AS (SELECT COUNT(v) AS n, SUM(v) / COUNT(v) AS m FROM l),
k AS (SELECT ANY_VALUE(n) AS n, SUM(pow(m - v, 3)) / (6 * pow(SUM(pow(m - v, 2)), 1.5)) AS acceleration FROM l, j)
SELECT ANY_VALUE(n) AS n_periods, ROUND(ANY_VALUE(o.a), 6) AS a, ROUND(ANY_VALUE(o.b), 6) AS b, ROUND(ANY_VALUE(o.b - o.a), 6) AS difference, ROUND(quantile_cont(d.b - d.a, 0.025), 6) AS low, ROUND(quantile_cont(d.b - d.a, 0.975), 6) AS high,
  ROUND(AVG(CAST(d.b - d.a < o.b - o.a AS DOUBLE)), 6) AS below, ROUND(ANY_VALUE(acceleration), 6) AS acceleration FROM d, d o, k WHERE d.replicate >= 0 AND o.replicate < 0 AND d.b - d.a IS NOT NULL
""")
def queue_bootstrap_interval(spark, d):
    return rounded(_bootstrapped(spark, d).interval().drop("bca_low", "bca_high"))


# formulaic predictions: the second model is what is tested
_BASE = """b AS (SELECT event_id, CAST(event_id % 5 AS INTEGER) AS fold, y, 0.05 + ((event_id * 37) % 101) / 101.0 * 0.5 + y * 0.25 AS p1, 0.05 + ((event_id * 53) % 97) / 97.0 * 0.6 + y * 0.15 AS p2
  FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events))"""


def _base(spark, d):
    t = table(spark, d, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("fold"), (F.col("event_type") == "error").cast("int").alias("y"))
    p1 = F.lit(0.05) + ((F.col("event_id") * 37) % 101) / F.lit(101.0) * 0.5 + F.col("y") * 0.25
    return t.withColumns({"p1": p1, "p2": F.lit(0.05) + ((F.col("event_id") * 53) % 97) / F.lit(97.0) * 0.6 + F.col("y") * 0.15})


# two models in closed form: both if both weights are positive, else the better one alone
_STACK = f"""
WITH {_BASE}, o AS (SELECT UNNEST([-1, 0, 1, 2, 3, 4]) AS fold),
g AS (SELECT o.fold, SUM(p1 * p1) AS a, SUM(p1 * p2) AS b, SUM(p2 * p2) AS c, SUM(p1 * y) AS u, SUM(p2 * y) AS v FROM o, b WHERE b.fold <> o.fold GROUP BY o.fold),
s AS (SELECT *, (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2 FROM g),
w AS (SELECT fold, a, b, c, u, v, CASE WHEN w1 > 0 AND w2 > 0 THEN w1 WHEN u * u / a >= v * v / c THEN greatest(0, u / a) ELSE 0 END AS w1, CASE WHEN w1 > 0 AND w2 > 0 THEN w2 WHEN u * u / a >= v * v / c THEN 0 ELSE greatest(0, v / c) END AS w2 FROM s)
"""


@R.add(_STACK + """, k AS (SELECT CAST(fold AS INTEGER) AS fold, 'p1' AS model, w1 AS weight, a * w1 + b * w2 - u AS slack FROM w UNION ALL SELECT fold, 'p2', w2, b * w1 + c * w2 - v FROM w)
SELECT fold, model, ROUND(weight, 6) AS weight, ROUND(slack, 6) + 0.0 AS slack, weight >= 0 AND slack >= -1e-6 AND abs(weight * slack) < 1e-6 AS holds FROM k""")
def stacking_conditions(spark, d):
    b = _base(spark, d)
    out = rounded(K.NonNegative(b, "y", ["p1", "p2"], "fold").conditions(b))
    return out.withColumn("slack", F.col("slack") + F.lit(0.0))


def _logistic_sql() -> str:
    rows = "(SELECT o.fold, ln(p1 / (1 - p1)) AS x1, ln(p2 / (1 - p2)) AS x2, y FROM o, b WHERE b.fold <> o.fold)"
    sql = ["n0 AS (SELECT fold, 0.0 AS w1, 0.0 AS w2 FROM o)"]
    for i in range(12):
        sql += [
            f"d{i} AS (SELECT fold, w1, w2, SUM((y - p) * x1) - w1 AS u, SUM((y - p) * x2) - w2 AS v, SUM(p * (1 - p) * x1 * x1) + 1 AS a, SUM(p * (1 - p) * x1 * x2) AS b, SUM(p * (1 - p) * x2 * x2) + 1 AS c FROM (SELECT r.*, w1, w2, 1 / (1 + exp(-(w1 * x1 + w2 * x2))) AS p FROM {rows} r JOIN n{i} USING (fold)) GROUP BY fold, w1, w2)",
            f"n{i + 1} AS MATERIALIZED (SELECT fold, w1 + (c * u - b * v) / (a * c - b * b) AS w1, w2 + (a * v - b * u) / (a * c - b * b) AS w2 FROM d{i})",
        ]
    return _STACK + ", " + ", ".join(sql) + """
SELECT event_id, ROUND(w.w1 * p1 + w.w2 * p2, 6) AS linear, ROUND(1 / (1 + exp(-(n.w1 * ln(p1 / (1 - p1)) + n.w2 * ln(p2 / (1 - p2))))), 6) AS logistic FROM b JOIN w USING (fold) JOIN n12 n USING (fold)"""


@R.add(_logistic_sql())
def stacked_predictions(spark, d):
    b = _base(spark, d)
    linear = K.NonNegative(b, "y", ["p1", "p2"], "fold").score(b, "linear")
    both = K.RidgeLogistic(b, "y", ["p1", "p2"], "fold", 5, intercept=False).score(linear, "logistic")
    return rounded(both.select("event_id", "linear", "logistic"))


@R.add("""
WITH RECURSIVE r AS (SELECT user_id AS series, value AS y, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
s AS (SELECT series, i, a AS alpha, y, CAST(NULL AS DOUBLE) AS f, CAST(y AS DOUBLE) AS level FROM r, (SELECT UNNEST([0.1, 0.3, 0.5, 0.9])::DOUBLE AS a) WHERE i = 1
  UNION ALL SELECT r.series, r.i, s.alpha, r.y, s.level, s.alpha * r.y + (1 - s.alpha) * s.level FROM s JOIN r ON r.series = s.series AND r.i = s.i + 1),
p AS (SELECT series, alpha, COUNT(*) AS n, AVG(pow(y - f, 2)) AS mse, arg_max(level, i) AS level FROM s GROUP BY ALL)
SELECT series, n, alpha, ROUND(mse, 6) AS mse, ROUND(level, 6) AS level FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY ROUND(mse, 9), alpha) = 1
""")
def exponential_smoothing(spark, d):
    return rounded(H.best_constants(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", [0.1, 0.3, 0.5, 0.9]))


@R.add("""
WITH RECURSIVE r AS (SELECT user_id AS series, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS y, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
d AS (SELECT series, y, t - COALESCE(LAG(t) OVER w, 0) AS gap, ROW_NUMBER() OVER w AS i FROM r WHERE y <> 0 WINDOW w AS (PARTITION BY series ORDER BY t)),
s AS (SELECT series, i, CAST(y AS DOUBLE) AS size, CAST(gap AS DOUBLE) AS gap FROM d WHERE i = 1
  UNION ALL SELECT d.series, d.i, 0.2 * d.y + 0.8 * s.size, 0.2 * d.gap + 0.8 * s.gap FROM s JOIN d ON d.series = s.series AND d.i = s.i + 1),
l AS (SELECT series, MAX(i) AS n_demands, arg_max(size, i) AS size, arg_max(gap, i) AS gap FROM s GROUP BY 1)
SELECT n.series, n.n, COALESCE(n_demands, 0) AS n_demands, ROUND(size, 6) AS size, ROUND(gap, 6) AS gap, ROUND(COALESCE(size / gap, 0), 6) AS forecast FROM (SELECT series, COUNT(*) AS n FROM r GROUP BY 1) n LEFT JOIN l USING (series)
""")
def intermittent_demand(spark, d):
    e = table(spark, d, "events").withColumn("demand", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    return rounded(H.croston(e, "user_id", ["ts", "event_id"], "demand", 0.2))
