"""Signatures, joins, splits and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates as U
from ..operators import features as X
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import panel as N
from ..operators import retrieval as T
from ..operators import splits as S
from .base import Registry, rounded, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_SIG = "l_quantity, l_discount, l_tax, l_returnflag"
_FEATURES = _SIG.split(", ")


@R.add(f"""
WITH g AS (SELECT COUNT(*) AS n, COUNT(DISTINCT l_linestatus) AS t, COUNT(DISTINCT l_linenumber) AS g FROM lineitem GROUP BY {_SIG})
SELECT COUNT(*) AS n_signatures, COUNT(*) FILTER (WHERE n > 1) AS n_repeated_signatures, CAST(COALESCE(SUM(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_repeated_rows,
  COUNT(*) FILTER (WHERE t > 1) AS n_conflicting, COUNT(*) FILTER (WHERE g > 1) AS n_across_groups, COUNT(*) FILTER (WHERE g > 1 AND t > 1) AS n_conflicting_across_groups FROM g
""")
def signature_groups(spark, d):
    return U.signature_summary(table(spark, d, "lineitem"), _FEATURES, "l_linestatus", "l_linenumber")


@R.add(f"SELECT {_SIG}, COUNT(*) AS n, COUNT(DISTINCT l_linestatus) AS targets FROM lineitem GROUP BY {_SIG} HAVING COUNT(DISTINCT l_linestatus) > 1")
def conflicting_labels(spark, d):
    return U.signatures(table(spark, d, "lineitem"), _FEATURES, "l_linestatus").where("targets > 1").select(*_FEATURES, "n", "targets")


@R.add("SELECT p_brand, p_type, COUNT(*) AS n, COUNT(DISTINCT p_size) AS groups FROM part GROUP BY 1, 2 HAVING COUNT(DISTINCT p_size) > 1")
def signatures_across_groups(spark, d):
    return U.signatures(table(spark, d, "part"), ["p_brand", "p_type"], group="p_size").where("groups > 1").select("p_brand", "p_type", "n", "groups")


@R.add("SELECT COUNT(*) AS n_groups, (SELECT COUNT(DISTINCT n_regionkey) FROM nation) AS n_targets, MAX(t) <= 1 AS is_function FROM (SELECT n_nationkey, COUNT(DISTINCT n_regionkey) AS t FROM nation GROUP BY 1)")
def target_function_of_group(spark, d):
    return U.target_by_group(table(spark, d, "nation"), "n_nationkey", "n_regionkey")


@R.add("""
WITH f AS (SELECT *, CAST('0x' || substr(md5('7|' || user_id), 1, 8) AS BIGINT) % 5 AS fold FROM events)
SELECT CAST(fold AS VARCHAR) AS partition, CAST(COUNT(*) AS BIGINT) AS n_rows, COUNT(DISTINCT event_type) AS n_classes,
  (SELECT MIN(n) FROM (SELECT fold AS f2, event_type, COUNT(*) AS n FROM f GROUP BY ALL) WHERE f2 = f.fold) AS least_support, (SELECT COUNT(DISTINCT event_type) FROM f) - COUNT(DISTINCT event_type) AS n_missing,
  (SELECT COALESCE(CAST(to_json(list(c ORDER BY c)) AS VARCHAR), '[]') FROM (SELECT DISTINCT event_type AS c FROM f WHERE event_type IS NOT NULL) WHERE c NOT IN (SELECT event_type FROM f AS h WHERE h.fold = f.fold AND event_type IS NOT NULL)) AS missing_classes
FROM f GROUP BY fold
""")
def fold_audit(spark, d):
    return S.fold_audit_by_name(S.group_split(table(spark, d, "events"), "user_id"), "fold", "event_type")


# values of clerks that months lack: most pairs are missing
@R.add("""
WITH t AS (SELECT strftime(o_orderdate, '%Y-%m') AS partition, nullif(CAST(o_custkey % 90 AS VARCHAR), '7') AS class FROM orders),
p AS (SELECT DISTINCT partition FROM t), c AS (SELECT DISTINCT CASE WHEN class = '5' THEN '' ELSE class END AS class FROM t WHERE class IS NOT NULL),
s AS (SELECT DISTINCT partition, CASE WHEN class = '5' THEN '' ELSE class END AS class FROM t)
SELECT p.partition, c.class FROM p CROSS JOIN c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.partition = p.partition AND s.class = c.class)
""")
def missing_classes(spark, d):
    label = F.nullif((F.col("o_custkey") % 90).cast("string"), F.lit("7"))
    t = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.when(label == "5", "").otherwise(label).alias("label"))
    return S.missing_classes(t, "month", "label")


@R.add("SELECT COUNT(*) AS n_groups, COUNT(*) FILTER (WHERE f > 1) AS n_crossing FROM (SELECT user_id, COUNT(DISTINCT event_id % 2) AS f FROM events GROUP BY 1)")
def group_fold_crossing(spark, d):
    return S.overlap(table(spark, d, "events").withColumn("fold", F.col("event_id") % 2), "user_id", "fold")


@R.add("SELECT CAST(user_id AS VARCHAR) AS group_value, COUNT(DISTINCT event_id % 2) AS n_folds FROM events GROUP BY 1 HAVING COUNT(DISTINCT event_id % 2) > 1 ORDER BY 1 LIMIT 5")
def crossing_examples(spark, d):
    return S.crossing_groups(table(spark, d, "events").withColumn("fold", F.col("event_id") % 2), "user_id", "fold")


@R.add("""
WITH c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END AS k FROM customer)
SELECT (SELECT COUNT(*) FROM orders) AS left_rows, (SELECT COUNT(*) FROM c) AS right_rows,
  (SELECT COUNT(*) FROM (SELECT k FROM c WHERE k IS NOT NULL GROUP BY k HAVING COUNT(*) > 1)) AS right_duplicate_keys,
  (SELECT COUNT(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM c WHERE k = o.o_custkey)) AS orphans, (SELECT COUNT(*) FROM orders o JOIN c ON k = o.o_custkey) AS matched_rows
""")
def join_integrity(spark, d):
    # keys that no order has make the orphans
    c = table(spark, d, "customer").withColumn("c_custkey", F.expr("CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END"))
    return J.join_integrity(table(spark, d, "orders"), c, "o_custkey", "c_custkey")


@R.add("""
WITH f AS (SELECT doc_id, lang, n_chars, CAST('0x' || substr(md5('7|' || doc_id), 1, 8) AS BIGINT) % 5 AS fold FROM documents)
SELECT q.doc_id FROM f q WHERE fold = 0 AND EXISTS (SELECT 1 FROM f c WHERE c.fold <> 0 AND c.lang = q.lang AND c.n_chars = q.n_chars)
""")
def context_query_isolation(spark, d):
    t = S.group_split(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return J.isolation_violations(t.where("fold != 0"), t.where("fold = 0"), ["lang", "n_chars"]).select("doc_id")


@R.add("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS at, MAX(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT event_id, value AS last_view FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.at
""")
def asof_feature(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), "value")
    return J.asof_join(left, right, "user_id", "ts", "at", "value", "last_view").select("event_id", "last_view")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01' - INTERVAL 97 DAY")
def maturity_filter(spark, d):
    return J.mature(table(spark, d, "orders"), "o_orderdate", "2000-01-01", 90, 7).select("o_orderkey")


@R.add("""
WITH f AS (SELECT *, CAST('0x' || substr(md5('7|' || o_custkey), 1, 8) AS BIGINT) % 5 AS fold FROM orders), k AS (SELECT UNNEST(range(5)) AS outer_fold)
SELECT CAST(outer_fold AS INTEGER) AS outer_fold, fold = outer_fold AS is_validation, COUNT(*) AS n FROM f, k GROUP BY ALL
""")
def fold_expansion(spark, d):
    t = S.group_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return J.fold_expansion(t, "fold", 5).groupBy("outer_fold", "is_validation").agg(F.count(F.lit(1)).alias("n"))


@R.add("""
SELECT COUNT(x) AS n_a, COUNT(y) AS n_b, COUNT(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_paired, ROUND(AVG(y - x), 6) AS mean_difference
FROM (SELECT CASE WHEN event_id % 3 = 0 THEN -event_id - 1 ELSE event_id END AS k, value AS x FROM events)
FULL JOIN (SELECT CASE WHEN event_id % 2 = 1 THEN -event_id - 1000000000000 ELSE event_id END AS k, value * 2 AS y FROM events) USING (k)
""")
def paired_comparison(spark, d):
    e = table(spark, d, "events")
    # rows whose ids the other side lacks stay unpaired
    a = e.withColumn("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN -event_id - 1 ELSE event_id END"))
    b = e.withColumn("event_id", F.expr("CASE WHEN event_id % 2 = 1 THEN -event_id - 1000000000000 ELSE event_id END"))
    return rounded(J.paired(a, b.withColumn("value", F.col("value") * 2), "event_id", "value"))


@R.add("""
WITH i AS (SELECT CAST(UNNEST(range(0, 2000, 100)) AS DOUBLE) AS a)
SELECT p_partkey, a, b FROM part JOIN (SELECT a, a + 150 AS b FROM i) ON p_retailprice >= a AND p_retailprice < b
""")
def interval_join(spark, d):
    i = spark.range(0, 2000, 100).select(F.col("id").cast("double").alias("a"), (F.col("id") + 150).cast("double").alias("b"))
    return J.interval_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), i, "p_retailprice", "a", "b", 200.0).select("p_partkey", "a", "b")


@R.add("SELECT o_orderkey, CAST(CAST('0x' || substr(md5('7|' || o_custkey), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM orders")
def group_split(spark, d):
    return S.group_split(table(spark, d, "orders"), "o_custkey").select("o_orderkey", "fold")


@R.add("SELECT o_orderkey, CAST((ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY md5('7|' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def stratified_split(spark, d):
    return S.stratified_split(table(spark, d, "orders"), "o_orderstatus", ["o_orderkey"]).select("o_orderkey", "fold")


@R.add("""
WITH o AS (SELECT * FROM (VALUES (0, TIMESTAMP '1998-01-01'), (1, TIMESTAMP '1999-01-01'), (2, TIMESTAMP '2000-01-01')) v(origin, cutoff)),
p AS (SELECT origin, CASE WHEN o_orderdate < cutoff - INTERVAL 30 DAY THEN 'train' WHEN o_orderdate >= cutoff AND o_orderdate < cutoff + INTERVAL 90 DAY THEN 'test' END AS part FROM orders, o)
SELECT origin, part, COUNT(*) AS n FROM p WHERE part IS NOT NULL GROUP BY ALL
""")
def rolling_origin(spark, d):
    t = S.rolling_origin(table(spark, d, "orders"), "o_orderdate", ["1998-01-01", "1999-01-01", "2000-01-01"], 90, 30)
    return t.groupBy("origin", "part").agg(F.count(F.lit(1)).alias("n"))


@R.add("""
SELECT part, COUNT(*) AS n FROM (SELECT CASE WHEN mine AND late THEN 'test' WHEN NOT mine AND NOT late THEN 'train' ELSE 'excluded' END AS part FROM (
  SELECT CAST('0x' || substr(md5('7|' || o_custkey), 1, 8) AS BIGINT) % 5 = 0 AS mine, o_orderdate >= TIMESTAMP '1999-01-01' AS late FROM orders)) GROUP BY part
""")
def grouped_temporal_split(spark, d):
    return S.grouped_temporal(table(spark, d, "orders"), "o_custkey", "o_orderdate", "1999-01-01").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT o_orderkey, CAST(CAST('0x' || substr(md5('7|' || o_orderkey), 1, 8) AS BIGINT) % 5 AS INTEGER) AS outer_fold, CAST(CAST('0x' || substr(md5('8|' || o_orderkey), 1, 8) AS BIGINT) % 3 AS INTEGER) AS inner_fold FROM orders")
def nested_cv(spark, d):
    return S.nested_folds(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "outer_fold", "inner_fold")


@R.add("""
SELECT p_partkey, CAST(CAST('0x' || substr(md5('7|' || sha256(length(p_brand) || ':' || p_brand || length(p_type) || ':' || p_type || length(p_size::VARCHAR) || ':' || p_size)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM part
""")
def signature_split(spark, d):
    return S.signature_split(table(spark, d, "part"), ["p_brand", "p_type", "p_size"]).select("p_partkey", "fold")


@R.add("""
WITH f AS (SELECT CAST(CAST('0x' || substr(md5('7|' || o_custkey), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, CAST(o_orderkey AS VARCHAR) AS k FROM orders),
i AS (SELECT fold, UNNEST([0, 1, 2, 3]) AS i, CAST('0x' || substr(sha256(k), 15 * UNNEST([0, 1, 2, 3]) + 1, 15) AS BIGINT) AS x FROM f),
s AS (SELECT fold, i, COUNT(*) AS n, CAST(SUM(x) AS VARCHAR) AS s FROM i GROUP BY ALL)
SELECT fold, MAX(n) AS n, sha256(MAX(n) || ',' || string_agg(s, ',' ORDER BY i)) AS fingerprint FROM s GROUP BY fold
""")
def split_fingerprint(spark, d):
    return S.split_fingerprint(S.group_split(table(spark, d, "orders"), "o_custkey"), "o_orderkey", "fold")


@R.add("SELECT event_id, LAG(value, 1) OVER w AS lag_1, LAG(value, 3) OVER w AS lag_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_features(spark, d):
    return X.lag_features(table(spark, d, "events"), "user_id", "ts", "event_id", "value", [1, 3]).select("event_id", "lag_1", "lag_3")


@R.add("SELECT event_id, ROUND(AVG(value) OVER w, 6) AS rolling_mean, ROUND(SUM(value) OVER w, 6) AS rolling_sum, COUNT(value) OVER w AS rolling_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def shifted_rolling(spark, d):
    return rounded(X.shifted_rolling(table(spark, d, "events"), "user_id", "ts", "event_id", "value", 5).select("event_id", "rolling_mean", "rolling_sum", "rolling_n"))


@R.add("SELECT event_id, ROUND(AVG(value) OVER w, 6) AS rolling_mean, COUNT(value) OVER w AS rolling_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)")
def shifted_rolling_days(spark, d):
    return rounded(X.shifted_rolling_days(table(spark, d, "events"), "user_id", "ts", "value", 7).select("event_id", "rolling_mean", "rolling_n"))


@R.add("SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def causal_fill(spark, d):
    t = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return X.causal_fill(t, "user_id", "ts", "event_id", "value", "filled").select("event_id", "filled")


@R.add("SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) AS INTEGER) AS day_of_week, CAST(hour(ts) AS INTEGER) AS hour, isodow(ts) >= 6 AS is_weekend FROM events")
def calendar_features(spark, d):
    return X.calendar_features(table(spark, d, "events"), "ts").select("event_id", "year", "month", "day", "day_of_week", "hour", "is_weekend")


_FOLD = "CAST('0x' || substr(md5('7|' || o_orderkey), 1, 8) AS BIGINT) % 5"


@R.add(f"""
WITH f AS (SELECT *, {_FOLD} AS fold, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders),
c AS (SELECT o_orderpriority AS v, fold, SUM(y) AS s, COUNT(*) AS n FROM f GROUP BY ALL), v AS (SELECT v, SUM(s) AS s, SUM(n) AS n FROM c GROUP BY v),
p AS (SELECT fold, (SELECT SUM(y) FROM f) - SUM(s) AS s, (SELECT COUNT(*) FROM f) - SUM(n) AS n FROM c GROUP BY fold)
SELECT o_orderkey, ROUND((v.s - c.s + 20.0 * (p.s / p.n)) / (v.n - c.n + 20.0), 6) AS encoded
FROM f JOIN c ON f.o_orderpriority = c.v AND f.fold = c.fold JOIN v ON v.v = c.v JOIN p ON p.fold = f.fold
""")
def target_encoding_crossfit(spark, d):
    t = S.group_split(table(spark, d, "orders"), "o_orderkey").withColumn("y", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return rounded(X.target_encoding(t, "o_orderpriority", "y", "fold").select("o_orderkey", "encoded"))


@R.add(f"""
WITH f AS (SELECT *, {_FOLD} AS fold FROM orders), t AS (SELECT o_orderpriority AS v, COUNT(*) / CAST((SELECT COUNT(*) FROM f WHERE fold <> 0) AS DOUBLE) AS share FROM f WHERE fold <> 0 GROUP BY 1)
SELECT o_orderkey, ROUND(COALESCE(share, 0), 6) AS frequency FROM f LEFT JOIN t ON f.o_orderpriority = t.v
""")
def frequency_encoding(spark, d):
    t = S.group_split(table(spark, d, "orders"), "o_orderkey")
    return rounded(X.frequency_encoding(t.where("fold != 0"), t, "o_orderpriority", "frequency").select("o_orderkey", "frequency"))


@R.add("SELECT l_orderkey, l_linenumber, CAST(l_discount = 0 AS INTEGER) AS l_discount_missing FROM lineitem")
def missing_indicator(spark, d):
    t = table(spark, d, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return X.missing_indicator(t, ["l_discount"]).select("l_orderkey", "l_linenumber", "l_discount_missing")


@R.add(f"""
WITH f AS (SELECT o_orderkey, {_FOLD} AS fold, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders),
m AS (SELECT g.fold, (SELECT median(v) FROM f WHERE f.fold <> g.fold) AS m FROM (SELECT DISTINCT fold FROM f) g)
SELECT o_orderkey, ROUND(COALESCE(v, m), 6) AS filled FROM f JOIN m USING (fold)
""")
def fold_median_impute(spark, d):
    t = S.group_split(table(spark, d, "orders"), "o_orderkey").withColumn("v", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return rounded(X.fold_median_impute(t, "v", "fold", "filled").select("o_orderkey", "filled"))


@R.add("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\", CAST(o_orderstatus NOT IN ('F', 'O') AS INTEGER) AS o_orderstatus_other FROM orders")
def one_hot(spark, d):
    return X.one_hot(table(spark, d, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_other")


@R.add("SELECT p_partkey, ROUND((p_retailprice - (SELECT AVG(p_retailprice) FROM part WHERE p_partkey % 2 = 0)) / (SELECT stddev_samp(p_retailprice) FROM part WHERE p_partkey % 2 = 0), 6) AS p_retailprice_z FROM part")
def standard_scale(spark, d):
    t = table(spark, d, "part")
    return rounded(X.standard_scale(t.where("p_partkey % 2 = 0"), t, ["p_retailprice"]).select("p_partkey", "p_retailprice_z"))


@R.add("SELECT p_partkey, ROUND(GREATEST((SELECT quantile_cont(p_retailprice, 0.01) FROM part), LEAST((SELECT quantile_cont(p_retailprice, 0.99) FROM part), p_retailprice)), 6) AS winsorised FROM part")
def winsorise(spark, d):
    t = table(spark, d, "part")
    return rounded(X.winsorise(t, t, "p_retailprice").select("p_partkey", "winsorised"))


@R.add("SELECT quality AS target_value, COUNT(*) AS n, ROUND((SELECT COUNT(*) FROM labels) / ((SELECT COUNT(DISTINCT quality) FROM labels) * CAST(COUNT(*) AS DOUBLE)), 6) AS weight FROM labels GROUP BY 1")
def class_weights(spark, d):
    return rounded(X.class_weights(table(spark, d, "labels"), "quality"))


@R.add("SELECT doc_id, CASE WHEN toxic = 1 THEN 1.0 ELSE 4.0 END AS weight FROM labels WHERE toxic = 1 OR CAST('0x' || substr(md5('7|' || doc_id), 1, 8) AS BIGINT) % 1000000 < 250000")
def negative_sampling(spark, d):
    return X.negative_sample(table(spark, d, "labels"), "toxic", ["doc_id"], 0.25).select("doc_id", "weight")


@R.add("""
WITH t AS (SELECT item_id, UNNEST(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark), f AS (SELECT item_id, term, COUNT(*) AS tf FROM t WHERE length(term) >= 3 GROUP BY ALL),
g AS (SELECT term, COUNT(*) AS df FROM f GROUP BY 1), s AS (SELECT item_id, term, tf, df, tf * ln((1 + (SELECT COUNT(*) FROM benchmark)) / CAST(1 + df AS DOUBLE)) AS tfidf FROM f JOIN g USING (term))
SELECT item_id, term, tf, df, ROUND(tfidf, 6) AS tfidf FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ROUND(tfidf, 9) DESC, term) AS i FROM s) WHERE i <= 5
""")
def tfidf_top_terms(spark, d):
    return rounded(X.tfidf_terms(table(spark, d, "benchmark"), "item_id", "text"))


@R.add("""
SELECT entity, n, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last, gaps, max_gap_days FROM (SELECT user_id AS entity, COUNT(*) AS n, MIN(d) AS first, MAX(d) AS last, COUNT(*) FILTER (WHERE g > 1) AS gaps, CAST(COALESCE(MAX(g), 0) AS INTEGER) AS max_gap_days FROM (
  SELECT user_id, d, d - LAG(d) OVER (PARTITION BY user_id ORDER BY d) AS g FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)) GROUP BY 1)
""")
def panel_structure(spark, d):
    return N.panel_structure(table(spark, d, "events"), "user_id", "ts").withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


_DAILY = "SELECT user_id AS entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2"


@R.add(f"""
WITH p AS ({_DAILY}) SELECT entity, day, LAG(n, 1) OVER w AS last_value, LAG(n, 7) OVER w AS seasonal_naive,
  ROUND(CASE WHEN ROW_NUMBER() OVER w > 2 THEN LAG(n, 1) OVER w + (LAG(n, 1) OVER w - FIRST_VALUE(n) OVER w) / CAST(ROW_NUMBER() OVER w - 2 AS DOUBLE) END, 6) AS drift,
  ROUND(AVG(n) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS moving_average FROM p WINDOW w AS (PARTITION BY entity ORDER BY day)
""")
def naive_forecasts(spark, d):
    p = N.daily(table(spark, d, "events"), "user_id", "ts", "value")
    return rounded(N.naive_forecasts(p, "entity", "day", "day", "n", 7, 3).select("entity", "day", "last_value", "seasonal_naive", "drift", "moving_average"))


@R.add("SELECT o_orderkey, CAST((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS batch FROM orders")
def query_batches(spark, d):
    return T.query_batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@R.add("SELECT p_partkey FROM part ORDER BY md5('7|' || p_partkey), p_partkey LIMIT 64")
def context_random(spark, d):
    return T.context(table(spark, d, "part").select("p_partkey"), "random::64", ["p_partkey"])


@R.add("""
WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS g FROM benchmark WHERE length(text) >= 3),
e AS (SELECT item_id, UNNEST(g) AS gram, len(g) AS n FROM g),
c AS (SELECT a.item_id AS query, b.item_id AS key, COUNT(*) AS common, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb FROM e a JOIN e b USING (gram) GROUP BY 1, 2),
s AS (SELECT *, common / CAST(na + nb - common AS DOUBLE) AS jaccard FROM c)
SELECT query, key, common, ROUND(jaccard, 6) AS jaccard FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY ROUND(jaccard, 9) DESC, key) AS i FROM s) WHERE i <= 3
""")
def char_ngram_retrieval(spark, d):
    b = table(spark, d, "benchmark")
    return rounded(T.ngram_retrieval(b, b, "item_id", "text", "item_id", "text"))


@R.add("""
WITH t AS (SELECT 'q' AS side, s_suppkey AS k, lower(s_name || ' ' || s_nationkey) AS t FROM supplier UNION ALL SELECT 'r', c_custkey, lower(c_name || ' ' || c_nationkey) FROM customer),
g AS (SELECT side, k, CAST('0x' || substr(md5(substr(t, i, 3)), 1, 8) AS BIGINT) % 1048576 AS g, COUNT(*) AS c FROM (SELECT *, UNNEST(range(1, length(t) - 1)) AS i FROM t) GROUP BY ALL),
n AS (SELECT side, k, sqrt(SUM(c * c)) AS norm FROM g GROUP BY ALL),
d AS (SELECT a.k AS query, b.k AS key, SUM(a.c * b.c) AS common FROM g a JOIN g b USING (g) WHERE a.side = 'q' AND b.side = 'r' GROUP BY ALL),
s AS (SELECT query, key, common, ROUND(common / (x.norm * y.norm), 9) AS similarity FROM d JOIN n x ON x.side = 'q' AND x.k = query JOIN n y ON y.side = 'r' AND y.k = key)
SELECT query, key, CAST(common AS BIGINT) AS common, ROUND(similarity, 6) AS similarity FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY query ORDER BY similarity DESC, key) <= 5
""")
def context_vectorsearch(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    asked = s.select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    rows = c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return rounded(T.vector_context(asked, rows, "vectorsearch::5", "c_custkey", "s_suppkey", ["name", "nation"]))


@R.add("SELECT COUNT(*) AS n_series, MIN(n) AS min_n, median(n) AS median_n, MAX(n) AS max_n, COUNT(*) FILTER (WHERE gaps > 0) AS with_gaps FROM (SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE g > 1) AS gaps FROM (SELECT user_id, d, d - LAG(d) OVER (PARTITION BY user_id ORDER BY d) AS g FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)) GROUP BY 1)")
def panel_summary(spark, d):
    return N.panel_summary(table(spark, d, "events"), "user_id", "ts")


# a few of the intervals span years
_SPANS = "SELECT o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 1 HOUR * (1 + o_orderkey % 60 + CASE WHEN o_orderkey % 5000 = 1 THEN 20000 ELSE 0 END) AS e FROM orders"


def _spans(spark, d):
    hours = F.lit(1) + F.col("o_orderkey") % 60 + F.when(F.col("o_orderkey") % 5000 == 1, 20000).otherwise(0)
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("s"), hours.alias("hours"))
    return t.select("o_orderkey", "s", (F.col("s") + F.make_dt_interval(hours=F.col("hours").cast("int"))).alias("e"))


@R.add(f"""
WITH o AS ({_SPANS}), l AS (SELECT l_shipdate AS s, l_shipdate + INTERVAL 1 HOUR * (6 + l_partkey % 30) AS e FROM lineitem)
SELECT o_orderkey, COUNT(*) AS n, CAST(SUM(epoch(least(o.e, l.e)) - epoch(greatest(o.s, l.s))) AS BIGINT) AS seconds FROM o JOIN l ON o.s < l.e AND l.s < o.e GROUP BY o_orderkey
""")
def interval_overlap(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("s2"), (F.col("l_shipdate") + F.make_dt_interval(hours=(F.lit(6) + F.col("l_partkey") % 30).cast("int"))).alias("e2"))
    met = I.overlap_totals(_spans(spark, d), l, "s", "e", "s2", "e2").groupBy("o_orderkey").agg(F.sum("n").alias("n"), F.sum("total").alias("micros"))
    return met.select("o_orderkey", "n", F.round(F.col("micros") / 1_000_000).cast("long").alias("seconds"))


@R.add(f"""
WITH o AS (SELECT *, CAST(year(s) % 5 AS INTEGER) AS fold FROM ({_SPANS})), f AS (SELECT UNNEST(range(5)) AS outer_fold),
v AS (SELECT fold, MAX(e) AS last FROM o GROUP BY fold),
m AS (SELECT p.o_orderkey, p.outer_fold, MAX(x.e) AS seen FROM (SELECT * FROM o CROSS JOIN f WHERE fold <> outer_fold) p ASOF JOIN (SELECT fold, s, MAX(e) OVER (PARTITION BY fold ORDER BY s) AS e FROM o) x ON x.fold = p.outer_fold AND p.e > x.s GROUP BY ALL)
SELECT o.o_orderkey, CAST(f.outer_fold AS INTEGER) AS outer_fold, CASE WHEN o.fold = f.outer_fold THEN 'validation' WHEN m.seen > o.s THEN 'purged' WHEN o.s >= v.last AND o.s < v.last + INTERVAL 30 DAY THEN 'embargoed' ELSE 'train' END AS role
FROM o CROSS JOIN f LEFT JOIN m ON m.o_orderkey = o.o_orderkey AND m.outer_fold = f.outer_fold LEFT JOIN v ON v.fold = f.outer_fold
""")
def purge_embargo(spark, d):
    t = _spans(spark, d).withColumn("fold", F.year("s") % 5)
    return I.purged_folds(t, "fold", 5, "s", "e", 30 * 86400e6).select("o_orderkey", "outer_fold", "role")
