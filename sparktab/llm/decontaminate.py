"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts are sequences of words (A-Z lower-cased; runs of ASCII letters and digits and of all other characters beyond ASCII). A
window is WINDOW consecutive words of an item, or the whole item if it is shorter. Winnowing hashes every K_GRAM-word gram
and keeps the minimum of each WINDOW - K_GRAM + 1 consecutive ones, so a shared run of WINDOW words always shares the
minimum of its own grams: no shared window is missed. Minima of documents are joined with those of the benchmark; the
windows that own a shared minimum are then compared word by word, and the hit windows extend to runs of words.

The benchmark's minima are broadcast only up to BROADCAST_ROWS of them, as counted; beyond that they are joined by a shuffle.

Defined results: null or wordless text has no words and is never hit; an item without words has no window; items that repeat
an item_id are one item with both rows' windows, and an item without item_id has the empty id; rows that share doc_id and
text get one result each; an empty benchmark hits nothing; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, ascii_lower, documents, fresh, materialise, table, text_hash

WINDOW, K_GRAM = 10, 5
BROADCAST_ROWS = 200_000
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def minima(df: DataFrame, length: int, prefix: str) -> tuple[DataFrame, str]:
    """Adds the column prefix+length: for each window of that many words the least gram hash; df has words and hashes."""
    k = min(K_GRAM, length)
    grams, out = f"{prefix}g{length}", f"{prefix}m{length}"
    tail = lambda name, n: F.slice(name, F.lit(1), F.greatest(F.size(name) - F.lit(n - 1), F.lit(0)))
    df = df.withColumn(grams, F.transform(tail("hashes", k), lambda x, i: F.xxhash64(F.lit(length), x, *[F.get("hashes", i + j) for j in range(1, k)])))
    span = length - k + 1
    if span > 1:
        df = df.withColumn(out, F.transform(tail(grams, span), lambda x, i: F.least(x, *[F.get(grams, i + j) for j in range(1, span)])))
        return df, out
    return df, grams


def _prepared(df: DataFrame) -> DataFrame:
    return df.withColumn("words", words(F.col("text"))).withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(minimum, window, set_id) per distinct window; (set_id, item), the items that hold it; and the windows' lengths."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = _prepared(items).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    lengths = sorted(r[0] for r in items.select(length).distinct().collect())
    parts = None
    for n in lengths:
        some, name = minima(items.where(length == n), n, "_")
        # outer: no filter on the array is inferred and pushed down
        some = some.select("item", "words", F.posexplode_outer(name).alias("at", "minimum"))
        some = some.select("item", "minimum", F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.lit(n))).alias("window"))
        parts = some if parts is None else parts.unionByName(some)
    if parts is None:
        parts = items.select("item", F.lit(0).cast("long").alias("minimum"), F.lit("").alias("window"))
    parts = materialise(parts.distinct())
    # windows of the same items share a set; a set's items are rows, however many items hold a passage
    sets = parts.groupBy("minimum", "window").agg(F.bit_xor(F.xxhash64("item")).alias("x"), F.count("*").alias("n"))
    sets = materialise(sets.select("minimum", "window", F.xxhash64("x", "n").alias("set_id")))
    members = parts.join(sets, ["minimum", "window"]).select("set_id", "item").distinct()
    return sets, materialise(members), lengths


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, text_key, n_words, n_hit, items (sorted ids of items with a window in it), spans.

    spans are the hit runs of words as (start, words); copies counts rows with this doc_id and text.
    """
    docs = docs.select("doc_id", "text").withColumn("text_key", text_hash(F.col("text")))
    windows, members, lengths = benchmark_windows(benchmark)
    df = _prepared(docs)
    names = []
    for n in lengths:
        df, name = minima(df, n, "_")
        names.append(name)
    # the null of each row stands for the row itself, so one pass also counts words and rows
    own = F.concat(F.array(F.lit(None).cast("long")), *[F.array_distinct(c) for c in names])
    n_words = F.size("words").cast("long").alias("n_words")
    found = df.select("doc_id", "text_key", n_words, F.explode_outer(own).alias("minimum"))
    # a key of its own for each row without a minimum, so that these don't meet in one task
    found = found.withColumn("met", F.coalesce("minimum", F.xxhash64("doc_id", "text_key")))
    shared = windows.select(F.col("minimum").alias("met")).distinct().withColumn("known", F.lit(True))
    found = found.join(_small(shared), "met", "left").where("minimum IS NULL OR known")
    count = F.count_if(F.col("minimum").isNull()).alias("copies")
    base = found.groupBy("doc_id", "text_key").agg(F.first("n_words").alias("n_words"), count, F.count("minimum").alias("hits"))
    base = materialise(base)
    hit = base.where("hits > 0").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    near = docs.join(hit, docs["doc_id"].eqNullSafe(hit["id"]) & (docs["text_key"] == hit["key"])).select("doc_id", "text_key", "text")
    near, spots = _prepared(near.dropDuplicates(["doc_id", "text_key"])), []
    for n in lengths:
        near, name = minima(near, n, "_")
        window = lambda i: F.concat_ws(" ", F.slice("words", i + 1, F.lit(n)))  # noqa: B023, E731
        each = lambda x, i: F.struct(i.alias("start"), F.lit(n).alias("words"), x.alias("met"), window(i).alias("window"))  # noqa: B023, E731
        spots.append(F.transform(name, each))
    empty = F.array().cast("array<struct<start:int,words:int,met:bigint,window:string>>")
    near = near.select("doc_id", "text_key", F.explode(F.concat(empty, *spots)).alias("s")).select("doc_id", "text_key", "s.*")
    near = near.join(_small(shared), "met").drop("met", "known")
    sure = near.join(_small(windows.select("window", "set_id").distinct()), "window")
    sure = materialise(sure.select("doc_id", "text_key", "start", "words", "set_id"))
    # windows that overlap or touch are one run
    own = Window.partitionBy("doc_id", "text_key").orderBy("start", "words")
    upto = F.max(F.col("start") + F.col("words")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = sure.select("doc_id", "text_key", "start", "words").distinct().withColumn("fresh", (F.col("start") > F.coalesce(upto, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(own)).groupBy("doc_id", "text_key", "run")
    runs = runs.agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("words")) - F.min("start")).alias("words"))
    runs = runs.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("runs"))
    items = sure.select("doc_id", "text_key", "set_id").distinct().join(members, "set_id")
    items = items.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    base, runs, items = base.alias("b"), runs.alias("s"), items.alias("i")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    out = base.join(runs, same("b", "s"), "left").join(items, same("b", "i"), "left")
    n_hit = F.aggregate("s.runs", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    no_items = F.array().cast("array<string>")
    return out.select(
        "b.doc_id", "b.text_key", "b.n_words", "b.copies", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce("i.items", no_items).alias("items"), F.col("s.runs").alias("spans"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = find(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window occurs in, with the columns of docs."""
    found = find(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    id_, key = fresh(docs, "_hit_id", "_hit_key")
    found = found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key))
    return docs.join(found, docs["doc_id"].eqNullSafe(found[id_]) & (text_hash(docs["text"]) == found[key]), "left_anti")


_WORDS = "regexp_extract_all(translate(COALESCE({0}, ''), '" + ASCII_UPPER + "', '" + ASCII_LOWER + "'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, LEAST(len(w), {WINDOW}) AS n, array_to_string(w[p : p + LEAST(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item, w, UNNEST(range(1, GREATEST(len(w) - {WINDOW} + 2, 2))) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, UNNEST(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, p, dw.n, item FROM dw JOIN iw USING (win)),
hw AS (SELECT doc_id, COUNT(*) AS n_hit FROM (SELECT DISTINCT doc_id, UNNEST(range(p, p + n)) AS pos FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
