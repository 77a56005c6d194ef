"""Findings, preflight, monitors and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..operators import profile as P
from ..plans import findings, preflight
from ..streaming import labels as delayed
from ..streaming import monitor
from .base import Registry, rounded, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("""
WITH t AS (SELECT COUNT(*) AS n, 3 * COUNT(*) - COUNT(doc_id) - COUNT(quality) - COUNT(toxic) AS gaps, COUNT(*) - LEAST(COUNT(doc_id), COUNT(quality), COUNT(toxic)) AS most,
  COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT quality, toxic FROM labels)) AS again, LEAST(COUNT(DISTINCT doc_id), COUNT(DISTINCT quality), COUNT(DISTINCT toxic)) AS least FROM labels),
c AS (SELECT COUNT(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)
SELECT 'info' AS severity, 'Dataset shape' AS title
UNION ALL SELECT CASE WHEN again > 0 THEN 'warning' ELSE 'positive' END, CASE WHEN again > 0 THEN 'Repeated observations' ELSE 'No repeated observations' END FROM t
UNION ALL SELECT CASE WHEN most >= 0.2 * n THEN 'warning' WHEN gaps > 0 THEN 'info' ELSE 'positive' END,
  CASE WHEN most >= 0.2 * n THEN 'Substantial missingness' WHEN gaps > 0 THEN 'Some values are missing' ELSE 'No missing values' END FROM t
UNION ALL SELECT 'warning', 'Constant columns' FROM t WHERE least <= 1
UNION ALL SELECT 'review', 'Possible identifiers' FROM (SELECT COUNT(doc_id) AS k FROM labels) WHERE k > 0
UNION ALL SELECT CASE WHEN MAX(n) >= 3 * MIN(n) THEN 'warning' ELSE 'info' END, 'Target class balance' FROM c HAVING COUNT(*) BETWEEN 2 AND 20
""")
def eda_findings(spark, d):
    df = table(spark, d, "labels")
    got = findings.make_findings(df, P.facts(df), target="toxic")
    return spark.createDataFrame([(f.severity, f.title) for f in got], "severity string, title string")


@R.add("""
WITH q AS (SELECT quality, COUNT(*) AS n, COUNT(DISTINCT toxic) AS k FROM labels GROUP BY quality), c AS (SELECT toxic, COUNT(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)
SELECT 'warning' AS severity, 'identifier_features_excluded' AS code, 'doc_id' AS columns FROM (SELECT COUNT(doc_id) AS n FROM labels) WHERE n > 0
UNION ALL SELECT 'blocker', 'missing_target', 'toxic' FROM (SELECT COUNT(*) AS n FROM labels WHERE toxic IS NULL) WHERE n > 0
UNION ALL SELECT 'blocker', 'singleton_class', 'toxic' FROM (SELECT MIN(n) AS n FROM c) WHERE n < 2
UNION ALL SELECT 'warning', 'small_class', 'toxic' FROM (SELECT MIN(n) AS n FROM c) WHERE n BETWEEN 2 AND 9
UNION ALL SELECT 'warning', 'substantive_duplicate_observations', '' FROM (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT quality, toxic FROM labels)) AS k FROM labels) WHERE n > k
UNION ALL SELECT 'warning', 'exact_feature_signature_grouping_fallback', '' FROM (SELECT MAX(n) AS n FROM q) WHERE n > 1
UNION ALL SELECT 'blocker', 'conflicting_labels_for_identical_features', '' FROM (SELECT MAX(k) AS k FROM q) WHERE k > 1
UNION ALL SELECT 'warning', 'constant_features', 'quality' FROM (SELECT COUNT(quality) AS k FROM q) WHERE k <= 1
UNION ALL SELECT 'warning', 'high_missingness', 'quality' FROM (SELECT COUNT(*) AS n, COUNT(quality) AS k FROM labels) WHERE 2 * k <= n
""")
def preflight_findings(spark, d):
    return preflight.findings_frame(table(spark, d, "labels"), preflight.Request("toxic", "one row per document", "before review"))


@R.add("""
WITH g AS (SELECT c_nationkey AS g, COUNT(*) AS n, COUNT(DISTINCT c_mktsegment) AS k FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1),
s AS (SELECT c_custkey, c_acctbal, COUNT(*) AS n, COUNT(DISTINCT c_mktsegment) AS k, COUNT(DISTINCT c_nationkey) AS g FROM customer GROUP BY 1, 2),
c AS (SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
SELECT 'warning' AS severity, 'identifier_features_excluded' AS code, 'c_name' AS columns FROM (SELECT COUNT(c_name) AS n, COUNT(DISTINCT c_name) AS k FROM customer) WHERE n >= 20 AND k >= 0.98 * n
UNION ALL SELECT 'blocker', 'singleton_class', 'c_mktsegment' FROM (SELECT MIN(n) AS n FROM c) WHERE n < 2
UNION ALL SELECT 'warning', 'small_class', 'c_mktsegment' FROM (SELECT MIN(n) AS n FROM c) WHERE n BETWEEN 2 AND 9
UNION ALL SELECT 'warning', 'substantive_duplicate_observations', '' FROM (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT c_custkey, c_acctbal, c_mktsegment FROM customer)) AS k FROM customer) WHERE n > k
UNION ALL SELECT 'blocker', 'conflicting_labels_for_identical_features', '' FROM (SELECT MAX(k) AS k FROM s) WHERE k > 1
UNION ALL SELECT 'blocker', 'insufficient_groups', 'c_nationkey' FROM (SELECT COUNT(*) AS n FROM g) WHERE n < 2
UNION ALL SELECT 'blocker', 'missing_group_values', 'c_nationkey' FROM (SELECT COUNT(*) AS n FROM customer WHERE c_nationkey IS NULL) WHERE n > 0
UNION ALL SELECT 'warning', 'singleton_only_groups', 'c_nationkey' FROM (SELECT MAX(n) AS n FROM g) WHERE n = 1
UNION ALL SELECT 'warning', 'feature_signatures_cross_groups', 'c_nationkey' FROM (SELECT MAX(g) AS g FROM s) WHERE g > 1
UNION ALL SELECT 'blocker', 'conflicting_labels_cross_groups', 'c_nationkey' FROM (SELECT COUNT(*) AS n FROM s WHERE g > 1 AND k > 1) WHERE n > 0
UNION ALL SELECT 'warning', 'target_dependent_group_assignment', 'c_nationkey' FROM (SELECT COUNT(*) AS n, MAX(k) AS k FROM g), (SELECT COUNT(DISTINCT c_mktsegment) AS t FROM customer) WHERE n >= 2 AND t >= 2 AND k <= 1
""")
def preflight_groups(spark, d):
    return preflight.findings_frame(table(spark, d, "customer"), preflight.Request("c_mktsegment", "one row per customer", "at signing", group="c_nationkey"))


# a fold column whose parts lack a class that has a part of its own, and whose users lie in several parts
@R.add("""
WITH e AS (SELECT event_type AS y, user_id, event_id, value, CASE WHEN event_type = 'error' THEN 'errors' ELSE 'part ' || event_id % 3 END AS fold FROM events),
p AS (SELECT fold, COUNT(DISTINCT y) AS k, MIN(n) AS n FROM (SELECT fold, y, COUNT(*) AS n FROM e GROUP BY ALL) GROUP BY fold), u AS (SELECT user_id, COUNT(DISTINCT fold) AS f FROM e GROUP BY user_id),
s AS (SELECT COUNT(*) AS n, COUNT(DISTINCT y) AS k, COUNT(DISTINCT user_id) AS g FROM e GROUP BY value), c AS (SELECT COUNT(*) AS n FROM e GROUP BY y)
SELECT 'warning' AS severity, 'identifier_features_excluded' AS code, 'event_id' AS columns FROM (SELECT COUNT(event_id) AS n FROM e) WHERE n > 0
UNION ALL SELECT 'warning', 'pipeline_metadata_excluded', 'fold' FROM (SELECT COUNT(fold) AS n FROM e) WHERE n > 0
UNION ALL SELECT 'blocker', 'singleton_class', 'y' FROM (SELECT MIN(n) AS n FROM c) WHERE n < 2
UNION ALL SELECT 'warning', 'small_class', 'y' FROM (SELECT MIN(n) AS n FROM c) WHERE n BETWEEN 2 AND 9
UNION ALL SELECT 'warning', 'substantive_duplicate_observations', '' FROM (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT value, y FROM e)) AS k FROM e) WHERE n > k
UNION ALL SELECT 'blocker', 'conflicting_labels_for_identical_features', '' FROM (SELECT MAX(k) AS k FROM s) WHERE k > 1
UNION ALL SELECT 'warning', 'singleton_only_groups', 'user_id' FROM (SELECT MAX(n) AS n FROM (SELECT COUNT(*) AS n FROM e GROUP BY user_id)) WHERE n = 1
UNION ALL SELECT 'warning', 'feature_signatures_cross_groups', 'user_id' FROM (SELECT MAX(g) AS g FROM s) WHERE g > 1
UNION ALL SELECT 'blocker', 'conflicting_labels_cross_groups', 'user_id' FROM (SELECT COUNT(*) AS n FROM s WHERE g > 1 AND k > 1) WHERE n > 0
UNION ALL SELECT 'blocker', 'fold_missing_classes', 'fold' FROM (SELECT COUNT(*) AS n FROM p WHERE k < (SELECT COUNT(*) FROM c)) WHERE n > 0
UNION ALL SELECT 'blocker', 'group_ids_cross_folds', 'fold,user_id' FROM (SELECT COUNT(*) AS n FROM u WHERE f > 1) WHERE n > 0
""")
def preflight_folds(spark, d):
    e = table(spark, d, "events")
    fold = F.when(F.col("event_type") == "error", "errors").otherwise(F.concat(F.lit("part "), F.col("event_id") % 3))
    t = e.select(F.col("event_type").alias("y"), "user_id", "event_id", "value", fold.alias("fold"))
    return preflight.findings_frame(t, preflight.Request("y", "one row per event", "at the event", group="user_id"))


@R.add("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS "end", event_type, COUNT(*) AS n, CAST(0 AS BIGINT) AS missing,
  ROUND(AVG(value), 6) AS mean, MIN(value) AS low, MAX(value) AS high FROM events GROUP BY ALL
""")
def windowed_monitor(spark, d):
    got = monitor.windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day")
    return rounded(got).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@R.add("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT MIN(ts) AS start, MAX(ts) + INTERVAL 6 HOUR AS "end", user_id, COUNT(*) AS n FROM s GROUP BY user_id, s
""")
def event_sessions(spark, d):
    got = monitor.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@R.add("SELECT toxic AS majority, ROUND(COUNT(*) / CAST((SELECT COUNT(*) FROM labels) AS DOUBLE), 6) AS share FROM labels GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1")
def prevalence_baseline(spark, d):
    return rounded(models.prevalence(table(spark, d, "labels"), "toxic"))


@R.add()
def logistic_baseline(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    model = models.fit(t, "y", ["l_quantity", "l_extendedprice", "l_discount"])
    return models.predict(model, t, ["l_quantity", "l_extendedprice", "l_discount"]).select("l_orderkey", "l_linenumber", "prediction", "probability")


# least squares by the normal equations of two centred columns
@R.add("""
WITH m AS (SELECT AVG(l_quantity) AS mq, AVG(l_tax) AS mt, AVG(l_extendedprice) AS my, var_pop(l_quantity) AS a, covar_pop(l_quantity, l_tax) AS b, var_pop(l_tax) AS c,
  covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_tax, l_extendedprice) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, ROUND(my + (c * u - b * v) / (a * c - b * b) * (l_quantity - mq) + (a * v - b * u) / (a * c - b * b) * (l_tax - mt), 3) AS prediction FROM lineitem, m
""")
def linear_baseline(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice")
    model = models.fit(t, "l_extendedprice", ["l_quantity", "l_tax"], family="linear")
    return rounded(models.predict(model, t, ["l_quantity", "l_tax"]).select("l_orderkey", "l_linenumber", "prediction"), 3)


@R.add()
def pca_outliers(spark, d):
    return models.pca_scores(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@R.add("""
WITH l AS (SELECT event_id, ts + INTERVAL 1 HOUR * (event_id % 40) AS at, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events WHERE value IS NOT NULL AND event_type <> 'view')
SELECT e.event_id, e.ts, l.at, l.y, CASE WHEN l.event_id IS NOT NULL THEN 'matured' ELSE 'lost' END AS status FROM events e LEFT JOIN l ON l.event_id = e.event_id AND l.at >= e.ts AND l.at <= e.ts + INTERVAL 24 HOUR
""")
def delayed_labels(spark, d):
    e = table(spark, d, "events")
    labels = e.where("value IS NOT NULL AND event_type <> 'view'")
    labels = labels.select("event_id", (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 40).cast("int"))).alias("at"), (F.col("event_type") == "error").cast("int").alias("y"))
    return delayed.delayed_labels(e.select("event_id", "ts"), labels, "event_id", "ts", "at", "24 hours")
