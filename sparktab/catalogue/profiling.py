"""Profiles, duplicates, distributions and associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.types import DATE_NAME, EDA_ID_NAME, PIPELINE_NAME
from ..operators import association as A
from ..operators import distribution as D
from ..operators import duplicates as U
from ..operators import profile as P
from ..operators import sketches as K
from ..sources import order
from .base import Registry, rounded, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _summary_sql(source: str, columns: list[str]) -> str:
    one = """
SELECT '{c}' AS column_name, COUNT(x) AS n_finite, MIN(x) AS min, ROUND(quantile_cont(x, 0.25), 6) AS q1, ROUND(quantile_cont(x, 0.5), 6) AS median,
  ROUND(quantile_cont(x, 0.75), 6) AS q3, MAX(x) AS max, ROUND(AVG(x), 6) AS mean, ROUND(stddev_samp(x), 6) AS std,
  (SELECT COUNT(*) FROM {s} WHERE {c} < (SELECT q1 - 1.5 * (q3 - q1) FROM f_{c}) OR {c} > (SELECT q3 + 1.5 * (q3 - q1) FROM f_{c})) AS outliers_iqr
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {s})"""
    fences = ", ".join(f"f_{c} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})" for c in columns)
    return f"WITH {fences}" + " UNION ALL ".join(one.format(c=c, s=source) for c in columns)


@R.add(_summary_sql("lineitem", _NUMBERS))
def column_profile_numeric(spark, d):
    out = P.numeric_summary(table(spark, d, "lineitem"), _NUMBERS)
    return rounded(out.drop("n_infinite", "is_approx"))


@R.add("""
SELECT 'lang' AS column_name, COUNT(*) - COUNT(lang) AS n_missing, COUNT(DISTINCT lang) AS n_distinct, 'category/text' AS role FROM documents
UNION ALL SELECT 'source', COUNT(*) - COUNT(source), COUNT(DISTINCT source), 'category/text' FROM documents
UNION ALL SELECT 'text', COUNT(*) - COUNT(text), COUNT(DISTINCT text), CASE WHEN COUNT(DISTINCT text) >= 0.98 * COUNT(text) THEN 'possible identifier' ELSE 'category/text' END FROM documents
UNION ALL SELECT 'doc_id', COUNT(*) - COUNT(doc_id), COUNT(DISTINCT doc_id), 'possible identifier' FROM documents
UNION ALL SELECT 'n_chars', COUNT(*) - COUNT(n_chars), COUNT(DISTINCT n_chars), 'numeric measure' FROM documents
""")
def column_profile_text(spark, d):
    return P.profile(table(spark, d, "documents")).select("column_name", "n_missing", "n_distinct", "role")


@R.add("""
SELECT c AS column_name, COUNT(*) AS n_rows, CAST(SUM(m) AS BIGINT) AS n_missing, ROUND(SUM(m) / COUNT(*), 6) AS missing_rate FROM (
  SELECT 'l_discount' AS c, CASE WHEN nullif(l_discount, 0.0) IS NULL THEN 1 ELSE 0 END AS m FROM lineitem
  UNION ALL SELECT 'l_tax', CASE WHEN nullif(l_tax, 0.0) IS NULL THEN 1 ELSE 0 END FROM lineitem
  UNION ALL SELECT 'l_quantity', 0 FROM lineitem) GROUP BY c
""")
def missing_rates(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return rounded(P.missing_rates(t))


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@R.add(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_distinct FROM orders" for c in _ORDERS))
def distinct_counts(spark, d):
    return P.distinct_counts(table(spark, d, "orders"))


@R.add("SELECT 'r_one' AS column_name, CAST(1 AS BIGINT) AS n_distinct UNION ALL SELECT 'r_null', CAST(0 AS BIGINT)")
def constant_columns(spark, d):
    return P.constant_columns(table(spark, d, "region").withColumn("r_one", F.lit("x")).withColumn("r_null", F.lit(None).cast("string")))


@R.add(_summary_sql("orders", ["o_totalprice"]).replace("n_finite, MIN(x) AS min", "n_finite, MIN(x) AS min"))
def iqr_outliers(spark, d):
    return rounded(P.numeric_summary(table(spark, d, "orders"), ["o_totalprice"]).drop("n_infinite", "is_approx"))


@R.add(_summary_sql("part", ["p_retailprice", "p_size"]))
def numeric_quartiles(spark, d):
    return rounded(P.numeric_summary(table(spark, d, "part"), ["p_retailprice", "p_size"]).drop("n_infinite", "is_approx"))


@R.add("SELECT 'x' AS column_name, COUNT(*) FILTER (WHERE value > 0.5) AS n_finite, COUNT(*) FILTER (WHERE value <= 0.5) AS n_infinite FROM events")
def infinite_counts(spark, d):
    t = table(spark, d, "events").select(F.when(F.col("value") > 0.5, F.col("value")).otherwise(F.lit(float("-inf"))).alias("x"))
    return P.numeric_summary(t, ["x"]).select("column_name", "n_finite", "n_infinite")


@R.add("SELECT COUNT(*) AS n_rows, CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM documents)) AS BIGINT) AS n_distinct, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM documents)) AS n_repeated FROM documents")
def exact_duplicates(spark, d):
    return U.duplicate_rows(table(spark, d, "documents"))


@R.add("SELECT COUNT(*) AS n_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS n_distinct, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS n_repeated FROM documents")
def substantive_duplicates(spark, d):
    return U.duplicate_rows(table(spark, d, "documents"), ["text", "lang", "source", "n_chars"])


def _role_sql(source: str, kinds: dict[str, str], target: str = "", time: str = "", group: str = "") -> str:
    """Each column's role from its values; kinds: n(umber), t(ext), d(ate or time), x (nested, as text)."""
    one = """
SELECT '{c}' AS column_name, CASE WHEN '{c}' = '{target}' THEN 'target' WHEN '{c}' = '{time}' THEN 'time' WHEN '{c}' = '{group}' THEN 'group'
  WHEN regexp_matches('{c}', '{pipeline}', 'i') THEN 'possible pipeline metadata'
  WHEN n > 0 AND (regexp_matches('{c}', '{identifier}', 'i') OR (n >= 20 AND k / n >= 0.98 AND '{kind}' <> 'n')) THEN 'possible identifier'
  WHEN regexp_matches('{c}', '{dated}', 'i') AND '{kind}' = 'd' THEN 'date/time-like'
  WHEN k <= 1 THEN 'constant' WHEN '{kind}' = 'n' THEN 'numeric measure' ELSE 'category/text' END AS role
FROM (SELECT COUNT({c}) AS n, CAST(COUNT(DISTINCT {c}) AS DOUBLE) AS k FROM {source})"""
    rules = {"pipeline": PIPELINE_NAME.pattern, "identifier": EDA_ID_NAME.pattern, "dated": DATE_NAME.pattern}
    named = {"source": source, "target": target, "time": time, "group": group}
    return " UNION ALL ".join(one.format(c=c, kind=kind, **rules, **named) for c, kind in kinds.items())


_CUSTOMER = {"c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t"}
_EVENTS = {"event_id": "n", "ts": "d", "user_id": "n", "event_type": "t", "value": "n", "props": "t"}


@R.add(_role_sql("customer", _CUSTOMER, target="c_mktsegment", group="c_nationkey"))
def role_assignment(spark, d):
    return P.profile(table(spark, d, "customer"), target="c_mktsegment", group="c_nationkey").select("column_name", "role")


@R.add(_role_sql("events", _EVENTS))
def identifier_screen(spark, d):
    return P.profile(table(spark, d, "events")).select("column_name", "role")


@R.add("SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
def value_counts_segment(spark, d):
    return P.value_counts(table(spark, d, "customer"), ["c_mktsegment"])


@R.add("SELECT COUNT(*) AS n_classes, MAX(n) AS largest, MIN(n) AS smallest, ROUND(MAX(n) / MIN(n), 6) AS ratio FROM (SELECT COUNT(*) AS n FROM labels GROUP BY toxic)")
def class_balance(spark, d):
    return rounded(P.class_balance(table(spark, d, "labels"), "toxic"))


@R.add("SELECT event_type AS label, COUNT(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, label LIMIT 12")
def top12_labels(spark, d):
    return D.top_labels(table(spark, d, "events"), "event_type")


@R.add("""
SELECT label, COUNT(*) AS n FROM (
  SELECT CASE WHEN p_size < 5 THEN '(missing)' WHEN p_size < 10 THEN '(blank)' WHEN length(t) > 48 THEN t[1:47] || '…' ELSE t END AS label
  FROM (SELECT p_size, trim(regexp_replace(p_name || '  ' || p_brand || ' ' || p_type || ' ' || p_name || ' ' || p_name || ' ' || p_name, '\\s+', ' ', 'g')) AS t FROM part)) GROUP BY label
""")
def label_normalised(spark, d):
    t = F.concat_ws(" ", "p_name", F.lit(""), "p_brand", "p_type", "p_name", "p_name", "p_name")
    raw = F.when(F.col("p_size") < 5, F.lit(None)).when(F.col("p_size") < 10, F.lit("  ")).otherwise(t)
    return table(spark, d, "part").groupBy(C.normal_label(raw).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _histogram_sql(source: str, column: str) -> str:
    return f"""
WITH s AS (SELECT COUNT({column}) AS n, MIN({column}) AS lo, MAX({column}) AS hi FROM {source}),
b AS (SELECT *, LEAST(18, GREATEST(4, CAST(floor(sqrt(n)) AS INTEGER))) AS k FROM s),
r AS (SELECT CAST(UNNEST(range(1, k + 1)) AS INTEGER) AS bin, lo, hi, k FROM b),
c AS (SELECT LEAST(CAST(floor(({column} - lo) / ((hi - lo) / k)) AS INTEGER) + 1, k) AS bin, COUNT(*) AS n FROM {source}, b WHERE {column} IS NOT NULL GROUP BY ALL)
SELECT r.bin, ROUND(lo + (r.bin - 1) * ((hi - lo) / k), 6) AS bin_start, ROUND(CASE WHEN r.bin = k THEN hi ELSE lo + r.bin * ((hi - lo) / k) END, 6) AS bin_end, COALESCE(n, 0) AS n
FROM r LEFT JOIN c ON r.bin = c.bin"""


@R.add(_histogram_sql("lineitem", "l_quantity"))
def histogram_quantity(spark, d):
    return rounded(D.histogram(table(spark, d, "lineitem"), "l_quantity"))


@R.add(_histogram_sql("events", "value"))
def histogram_value(spark, d):
    return rounded(D.histogram(table(spark, d, "events"), "value"))


@R.add("""SELECT CAST(ROW_NUMBER() OVER (ORDER BY period) AS INTEGER) AS bucket, period, n FROM (
SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS period, COUNT(*) AS n FROM orders GROUP BY 1)""")
def time_buckets_orders(spark, d):
    return D.time_buckets(table(spark, d, "orders"), "o_orderdate")


@R.add("""SELECT CAST(ROW_NUMBER() OVER (ORDER BY period) AS INTEGER) AS bucket, period, n FROM (
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, COUNT(*) AS n FROM events GROUP BY 1)""")
def time_buckets_events(spark, d):
    return D.time_buckets(table(spark, d, "events"), "ts")


@R.add("""SELECT CAST(b AS INTEGER) AS bucket, MIN(period) AS period, CAST(SUM(n) AS BIGINT) AS n FROM (
SELECT *, NTILE(36) OVER (ORDER BY period) AS b FROM (SELECT CAST(date_trunc('day', ts) + to_days(CAST(event_id % 60 AS INTEGER)) AS TIMESTAMP) AS period, COUNT(*) AS n FROM events GROUP BY 1)) GROUP BY b""")
def timeline_36(spark, d):
    spread = (F.col("ts") + F.make_dt_interval((F.col("event_id") % 60).cast("int"))).alias("ts")
    return D.time_buckets(table(spark, d, "events").select(spread), "ts")


@R.add("SELECT MIN(ts) AS first, MAX(ts) AS last, CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS missing FROM events")
def time_coverage(spark, d):
    return P.time_coverage(table(spark, d, "events"), "ts")


@R.add("SELECT COUNT(*) FILTER (WHERE ts < b) = 0 AS monotonic FROM (SELECT ts, LAG(ts) OVER (ORDER BY event_id) AS b FROM events)")
def time_monotonic(spark, d):
    return P.is_monotonic(table(spark, d, "events"), "ts", "event_id")


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 500")
def hash_sample_n(spark, d):
    return D.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 500, ["o_orderkey"])


_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@R.add(" UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, COUNT(*) AS n, ROUND(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def correlation_matrix(spark, d):
    return rounded(A.pearson_pairs(table(spark, d, "lineitem"), _NUMBERS))


@R.add("SELECT 'p_size' AS left_column, 'p_retailprice' AS right_column, COUNT(*) AS n, ROUND(corr(p_size, p_retailprice), 6) AS r FROM part UNION ALL SELECT 'p_size', 'one', COUNT(*), NULL FROM part UNION ALL SELECT 'p_retailprice', 'one', COUNT(*), NULL FROM part")
def pearson_pairs(spark, d):
    return rounded(A.pearson_pairs(table(spark, d, "part").withColumn("one", F.lit(1.0)), ["p_size", "p_retailprice", "one"]))


@R.add("SELECT 'double_price' AS feature, COUNT(*) AS n, 1.0 AS r FROM part")
def near_perfect(spark, d):
    t = table(spark, d, "part").withColumn("double_price", F.col("p_retailprice") * 2)
    return rounded(A.near_perfect(t, ["double_price", "p_size"], "p_retailprice"))


def _eta_sql(source: str, g: str, x: str) -> str:
    return f"""
WITH p AS (SELECT {g} AS g, COUNT(*) AS n, AVG({x}) AS m, var_pop({x}) AS v FROM {source} WHERE {g} IS NOT NULL GROUP BY 1),
t AS (SELECT SUM(n) AS n, COUNT(*) AS k, SUM(n * m) / SUM(n) AS mean FROM p)
SELECT CAST(t.n AS BIGINT) AS n, t.k AS n_groups, ROUND((SELECT SUM(n * (m - mean) * (m - mean)) FROM p) / (SELECT SUM(n * (m - mean) * (m - mean)) + SUM(n * v) FROM p), 6) AS eta_squared FROM t"""


@R.add(_eta_sql("lineitem", "l_returnflag", "l_extendedprice"))
def eta_squared(spark, d):
    return rounded(A.eta_squared(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@R.add("""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT *, SUM(n) OVER (PARTITION BY a) AS r, SUM(n) OVER (PARTITION BY b) AS k FROM c)
SELECT CAST(SUM(n) AS BIGINT) AS n, COUNT(DISTINCT a) AS n_rows, COUNT(DISTINCT b) AS n_columns,
  ROUND(sqrt(GREATEST(0, (SUM(n * n / CAST(r * k AS DOUBLE)) - 1) / (LEAST(COUNT(DISTINCT a), COUNT(DISTINCT b)) - 1))), 6) AS cramers_v FROM m
""")
def cramers_v(spark, d):
    return rounded(A.cramers_v(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@R.add("SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def crosstab(spark, d):
    return A.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@R.add("SELECT l_returnflag AS target_value, COUNT(*) AS n, ROUND(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1")
def conditional_medians(spark, d):
    return rounded(A.conditional_medians(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@R.add("SELECT o_orderpriority AS category, COUNT(*) AS n, ROUND(median(o_totalprice), 6) AS median FROM orders GROUP BY 1 ORDER BY n DESC, category LIMIT 5")
def conditional_target_median(spark, d):
    return rounded(A.conditional_target_median(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"))


@R.add("""
WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, COUNT(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT *, SUM(n) OVER (PARTITION BY a) AS total FROM c), r AS (SELECT *, DENSE_RANK() OVER (ORDER BY total DESC, a) AS lr, ROW_NUMBER() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM t)
SELECT a AS level, b AS target_value, n, ROUND(n / total, 6) AS share FROM r WHERE lr <= 4 AND k <= 5
""")
def conditional_composition(spark, d):
    return rounded(A.conditional_composition(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))


@R.add("""
SELECT * FROM (SELECT 'doc_id' AS column_name, COUNT(*) AS n_pairs, COUNT(*) FILTER (WHERE doc_id <> toxic) AS n_unequal, COUNT(*) FILTER (WHERE doc_id <> toxic) = 0 AS is_copy FROM labels
UNION ALL SELECT 'quality', COUNT(*), COUNT(*) FILTER (WHERE quality <> toxic), COUNT(*) FILTER (WHERE quality <> toxic) = 0 FROM labels
UNION ALL SELECT 'copy', COUNT(*), CAST(0 AS BIGINT), TRUE FROM labels UNION ALL SELECT 'text_copy', COUNT(*), CAST(0 AS BIGINT), TRUE FROM labels)
""")
def target_copy(spark, d):
    t = table(spark, d, "labels").withColumn("copy", F.col("toxic")).withColumn("text_copy", F.col("toxic").cast("string"))
    return A.target_copies(t, "toxic")


@R.add("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def html_text_strip(spark, d):
    return table(spark, d, "pages").select("page_id", C.strip_html(F.col("html")).alias("text"))


@R.add("SELECT page_id, CAST(len(regexp_extract_all(html, '{}', 1)) AS INTEGER) AS n_assets FROM pages".format(C.EXTERNAL.replace("'", "''")))
def external_assets(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(C.external_assets(F.col("html"))).alias("n_assets"))


@R.add("SELECT event_id, sha256(length(event_id::VARCHAR) || ':' || event_id || length(event_type) || ':' || event_type || CASE WHEN user_id % 2 = 0 THEN length(user_id::VARCHAR) || ':' || user_id ELSE '-' END) AS digest FROM events")
def row_digest(spark, d):
    t = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("even"))
    return t.select("event_id", C.row_digest(t.columns).alias("digest"))


@R.add("SELECT COUNT(*) FILTER (WHERE regexp_matches(d, '^(sha256:)?[0-9a-fA-F]{64}$')) AS n_digests, COUNT(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN sha256(props) ELSE props END AS d FROM events)")
def digest_check(spark, d):
    t = table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.sha2("props", 256)).otherwise(F.col("props")).alias("d"))
    return t.agg(F.count_if(C.is_sha256(F.col("d"))).alias("n_digests"), F.count(F.lit(1)).alias("n"))


@R.add()
def approx_distinct(spark, d):
    return P.approx_distinct_counts(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@R.add("SELECT COUNT(DISTINCT c_nationkey) AS n_groups, COUNT(*) FILTER (WHERE n = 1) AS singletons, MAX(n) AS largest, MIN(n) AS smallest, CAST(0 AS BIGINT) AS missing_rows FROM (SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1)")
def group_structure(spark, d):
    return P.group_structure(table(spark, d, "customer"), "c_nationkey")


@R.add("SELECT CAST(quality AS INTEGER) AS a, COUNT(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def class_support(spark, d):
    return P.class_support(table(spark, d, "labels"), "quality").select(F.col("class").cast("int").alias("a"), "n")


@R.add("""
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3))), ',') AS tokens FROM benchmark
""")
def tokenise(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(C.tokenise(F.col("text")), ",").alias("tokens"))


@R.add("SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, CASE WHEN event_id % 4 = 0 THEN TRUE ELSE FALSE END AS zoned FROM events")
def json_keys(spark, d):
    time = F.when(F.col("event_id") % 4 == 0, F.lit("2026-01-02T03:04:05+08:00")).when(F.col("event_id") % 4 == 1, F.lit("2026-13-02T03:04:05Z")).otherwise(F.col("ts").cast("string"))
    return table(spark, d, "events").select("event_id", F.array_join(C.json_keys(F.col("props")), ",").alias("keys"), C.is_zoned_time(time).alias("zoned"))


@R.add("""
SELECT event_id, array_to_string(list_transform(regexp_extract_all(props, '([-+]?\\d+(?:\\.\\d+)?(?:[eE][-+]?\\d+)?)'), lambda x: CAST(CAST(CAST(x AS DOUBLE) AS BIGINT) AS VARCHAR)), ',') AS numbers,
  CASE WHEN length(props || props || props) <= 12 THEN props || props || props ELSE left(props || props || props, 5) || '…' || right(props || props || props, 6) END AS short FROM events
""")
def numbers_in_text(spark, d):
    wide = F.concat("props", "props", "props")
    ints = F.transform(C.numbers_in(F.col("props")), lambda x: x.cast("long").cast("string"))
    return table(spark, d, "events").select("event_id", F.array_join(ints, ",").alias("numbers"), C.truncate_middle(wide, 12).alias("short"))


@R.add("SELECT CAST(ROW_NUMBER() OVER () - 1 AS BIGINT) AS position, l_orderkey, l_partkey, l_quantity FROM (SELECT * FROM lineitem LIMIT 5000)")
def source_head(spark, d):
    t = order.positioned(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"))
    return t.where("position < 5000").select("position", "l_orderkey", "l_partkey", "l_quantity")


@R.add("""
WITH e AS (SELECT ts, ROW_NUMBER() OVER () AS i FROM events), o AS (SELECT o_orderdate AS t, ROW_NUMBER() OVER () AS i FROM orders)
SELECT 'events' AS name, COALESCE(bool_and(ts >= before), TRUE) AS monotonic FROM (SELECT ts, LAG(ts) OVER (ORDER BY i) AS before FROM e) WHERE before IS NOT NULL
UNION ALL SELECT 'orders', COALESCE(bool_and(t >= before), TRUE) FROM (SELECT t, LAG(t) OVER (ORDER BY i) AS before FROM o) WHERE before IS NOT NULL
""")
def source_monotonic(spark, d):
    out = None
    for name, time in (("events", "ts"), ("orders", "o_orderdate")):
        t = table(spark, d, name)
        one = P.is_monotonic(t, time, *order.source_order(t)).select(F.lit(name).alias("name"), "monotonic")
        out = one if out is None else out.unionByName(one)
    return out


_SKETCHED = ["l_partkey", "l_suppkey", "l_extendedprice"]


# errors of merged sketches stay within their bounds; counts are exact
@R.add("""
WITH r AS (SELECT l_returnflag, UNNEST(['l_partkey', 'l_suppkey', 'l_extendedprice']) AS column_name, UNNEST([l_partkey, l_suppkey, l_extendedprice]) AS v FROM lineitem)
SELECT l_returnflag, column_name, COUNT(*) AS n, COUNT(v) AS n_values, TRUE AS distinct_holds, TRUE AS quantiles_hold FROM r GROUP BY ALL
""")
def sketch_store(spark, d):
    t = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    store = K.build(t, ["l_returnflag", "l_linestatus", "year"], [], _SKETCHED)
    answers = K.answer(store, ["l_returnflag"])
    holds = K.measured(t, answers, ["l_returnflag"], [], _SKETCHED)
    return answers.select("l_returnflag", "column_name", "n", "n_values").join(holds, ["l_returnflag", "column_name"])


@R.add("SELECT column_name, TRUE AS holds FROM (SELECT UNNEST(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice']) AS column_name) WHERE (SELECT COUNT(*) FROM orders) > 0")
def approx_distinct_error(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    both = P.approx_distinct_counts(t).withColumnRenamed("n_distinct", "guess").join(P.distinct_counts(t), "column_name")
    return both.select("column_name", (F.abs(F.col("guess") - F.col("n_distinct")) <= F.greatest(F.lit(1.0), 0.06 * F.col("n_distinct"))).alias("holds"))
