"""Line deduplication by content-defined chunks of lines, with DataFrame functions only.

A line's hash is its md5; a rolling hash over each line's hash and the one before it ends a chunk where its first hex digit
is below BOUNDARY, so chunks shift with the lines they hold. Of the chunks of two lines or more that several places of the
corpus hold, all but the first (least doc_id, then place) are removed, once their bytes are seen to equal the first's.

A repeated passage that crosses chunk boundaries keeps what lies outside whole chunks. remove_passages, which op10_passages
and the pipeline use, has no boundaries: a line goes if it and a neighbour are two consecutive lines that an earlier place of
the corpus (least doc_id, then place) holds, so every run of two lines or more that an earlier place holds goes whole. Pairs
of lines meet by hash, join to passages by the place they repeat, and each passage's bytes are compared with that place's.
The first place of a line is never removed, as no pair there can have an earlier one.

Chunks are grouped by hash with partial aggregation; a repeated chunk's text travels once per removed place, and the join
that sends it reads two plain exchanges, so that Spark splits the places of a common chunk over tasks. Lines end at line feeds alone.

Defined results: null text stays null and has no lines; empty text is one empty line, which is no chunk of two; rows that
share doc_id and text are one document; rows without doc_id come last; an empty table gives an empty result; a text whose
lines all go is empty; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, materialise, text_hash

BOUNDARY, LEAST_LINES = "6", 2


def _joined(lines: str, s: Column, e: Column) -> Column:
    return F.array_join(F.slice(lines, s + 1, e - s + 1), "\n")


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, s, e (first and last line), hash: each chunk of LEAST_LINES lines or more."""
    df = docs.where("text IS NOT NULL").withColumn("lines", F.split("text", "\n"))
    df = df.withColumn("hashes", F.transform("lines", lambda x: F.md5(x.cast("binary"))))
    rolled = lambda i: F.md5(F.concat(F.when(i > 0, F.get("hashes", i - 1)).otherwise(F.lit("")), F.get("hashes", i)).cast("binary"))
    every = F.sequence(F.lit(0), F.size("hashes") - 1)
    df = df.withColumn("ends", F.filter(every, lambda i: (F.substring(rolled(i), 1, 1) < F.lit(BOUNDARY)) | (i == F.size("hashes") - 1)))
    begin = lambda k: F.when(k > 0, F.get("ends", k - 1) + 1).otherwise(F.lit(0))
    df = df.withColumn("found", F.transform("ends", lambda e, k: F.struct(begin(k).alias("s"), e.alias("e"), F.xxhash64(F.lit(1), _joined("lines", begin(k), e)).alias("hash"))))
    df = df.select("doc_id", "text_key", F.explode_outer("found").alias("c")).select("doc_id", "text_key", "c.*")
    return df.where(F.col("e") - F.col("s") + 1 >= LEAST_LINES)


def remove_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text, n_lines, n_removed, n_chunks, kept (the text that is left) per row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_key"))
    found = materialise(chunks(docs))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "s")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    first = materialise(first)
    again = found.join(first, "hash").where(place != F.col("first")).select("hash", "doc_id", "text_key", "s", "e").distinct()
    # both joins with the documents hash the same columns, so that one exchange of the texts serves both
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k1"), F.col("doc_id").isNull().alias("k2"), "text_key", "doc_id", "text")
    own = lambda df, id_, key: df.withColumns({"j1": F.coalesce(id_.cast("string"), F.lit("")), "j2": id_.isNull(), "j3": key})
    same = [F.col("k1") == F.col("j1"), F.col("k2") == F.col("j2"), F.col("text_key") == F.col("j3")]
    lengths = found.join(first, "hash").where(place == F.col("first")).select("hash", "first", "e").distinct()
    wanted = own(lengths, F.col("first.doc_id"), F.col("first.text_key")).select("hash", F.col("first.s").alias("s"), "e", "j1", "j2", "j3")
    texts = keyed.join(wanted, same).withColumn("lines", F.split("text", "\n"))
    # written, so that a skewed join with the places of a common chunk can be split
    texts = materialise(texts.select("hash", _joined("lines", F.col("s"), F.col("e")).alias("first_text")).dropDuplicates(["hash"]))
    lists = again.join(texts, "hash").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("s", "e", "first_text"))).alias("again"))
    lists = own(lists, F.col("doc_id"), F.col("text_key")).select("j1", "j2", "j3", "again")
    out = keyed.join(lists, same, "left").select("doc_id", "text_key", "text", "again").withColumn("lines", F.split("text", "\n"))
    sure = F.filter("again", lambda x: _joined("lines", x["s"], x["e"]) == x["first_text"])
    out = out.withColumn("gone", F.transform(F.coalesce(sure, F.array().cast("array<struct<s:int,e:int,first_text:string>>")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    begin = lambda k: F.when(k > 0, F.get("gone", k - 1)["e"] + 1).otherwise(F.lit(0))
    end = lambda k: F.when(k < F.size("gone"), F.get("gone", k)["s"]).otherwise(F.size("lines"))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", begin(k) + 1, F.greatest(end(k) - begin(k), F.lit(0)))))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    n_removed = F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"] + 1)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    return out.select("doc_id", "text_key", "text", n_lines.alias("n_lines"), n_removed.alias("n_removed"), F.size("gone").cast("long").alias("n_chunks"), kept.alias("kept"))


def pairs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, s, hash: each line but the last with the line after it."""
    df = docs.where("text IS NOT NULL").withColumn("lines", F.split("text", "\n")).where(F.size("lines") > 1)
    hashes = F.transform(F.slice("lines", F.lit(1), F.size("lines") - 1), lambda x, i: F.xxhash64(x, F.get("lines", i + 1)))
    return df.select("doc_id", "text_key", F.posexplode(hashes).alias("s", "hash"))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, s, e, first_id, first_key, first_s: runs of lines s to e whose pairs an earlier place's run from first_s has."""
    found = materialise(pairs(docs))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "s")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    again = found.join(first, "hash").where(place != F.col("first"))
    again = again.select("doc_id", "text_key", "s", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), (F.col("first.s") - F.col("s")).alias("shift")).distinct()
    run = ["doc_id", "text_key", "first_id", "first_key", "shift"]
    again = again.withColumn("run", F.col("s") - F.row_number().over(Window.partitionBy(*run).orderBy("s")))
    again = again.groupBy(*run, "run").agg(F.min("s").alias("s"), (F.max("s") + 1).alias("e"))
    return again.select("doc_id", "text_key", "s", "e", "first_id", "first_key", (F.col("s") + F.col("shift")).alias("first_s"))


def cut_passages(docs: DataFrame, how: str = "inner") -> DataFrame:
    """doc_id, text_key, text, n_lines, n_removed, kept (the text that is left) per row of docs(doc_id, text).

    By an inner join only of documents with passages to remove. A filter on n_removed would be pushed into the expressions
    that make it and repeat them for every passage.
    """
    docs = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_key"))
    again = materialise(passages(docs))
    # both joins with the documents hash the same columns and read the same ones, so that one exchange of the texts serves both
    d = docs.alias("d")
    own = F.col("d.doc_id").eqNullSafe(F.col("r.id")) & (F.col("d.text_key") == F.col("r.key"))
    length = (F.col("e") - F.col("s")).alias("length")
    wanted = again.select(F.col("first_id").alias("id"), F.col("first_key").alias("key"), "first_s", length).distinct()
    wanted = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("first_s", "length")).alias("spans"))
    texts = d.join(wanted.alias("r"), own).select("d.doc_id", "d.text_key", F.split("d.text", "\n").alias("lines"), "r.spans").dropDuplicates(["doc_id", "text_key"])
    texts = texts.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"), "lines", F.explode("spans").alias("span"))
    texts = texts.select("first_id", "first_key", "span.*", _joined("lines", F.col("span.first_s"), F.col("span.first_s") + F.col("span.length")).alias("first_text"))
    a, t = again.withColumn("length", length).alias("a"), texts.alias("t")
    same = F.col("a.first_id").eqNullSafe(F.col("t.first_id")) & (F.col("a.first_key") == F.col("t.first_key"))
    same = same & (F.col("a.first_s") == F.col("t.first_s")) & (F.col("a.length") == F.col("t.length"))
    lists = a.join(t, same).groupBy(F.col("a.doc_id").alias("id"), F.col("a.text_key").alias("key"))
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("a.s", "a.e", "t.first_text"))).alias("again"))
    out = d.join(lists.alias("r"), own, how).select("d.doc_id", "d.text_key", "d.text", "r.again").withColumn("lines", F.split("text", "\n"))
    sure = F.filter("again", lambda x: _joined("lines", x["s"], x["e"]) == x["first_text"])
    out = out.withColumn("gone", F.transform(F.coalesce(sure, F.array().cast("array<struct<s:int,e:int,first_text:string>>")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    # a passage ends before the next one ends, and shares its last line with it at most
    begin = lambda k: F.when(k > 0, F.get("gone", k - 1)["e"] + 1).otherwise(F.lit(0))
    end = lambda k: F.when(k < F.size("gone"), F.get("gone", k)["s"]).otherwise(F.size("lines"))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", begin(k) + 1, F.greatest(end(k) - begin(k), F.lit(0)))))
    out = out.withColumn("left", F.when(F.size("gone") > 0, left))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join("left", "\n"))
    n_removed = F.when(F.size("gone") == 0, F.lit(0)).otherwise(F.size("lines") - F.size("left")).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    return out.select("doc_id", "text_key", "text", n_lines.alias("n_lines"), n_removed.alias("n_removed"), kept.alias("kept"))


def remove_passages(docs: DataFrame) -> DataFrame:
    """cut_passages for every row of docs."""
    return cut_passages(docs, "left")


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_chunks (removed), kept_sha256 (of the lines left) for every document."""
    out = remove_chunks(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed (lines of repeated passages), kept_sha256 (of the lines left) for every document."""
    out = remove_passages(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def linededup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their texts (and n_chars, if there is such a column) as line deduplication leaves them."""
    cut = cut_passages(docs.select("doc_id", "text"))
    id_, key, kept = fresh(docs, "_cut_id", "_cut_key", "_cut_text")
    cut = cut.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("kept").alias(kept)).dropDuplicates([id_, key])
    both = docs.join(cut, docs["doc_id"].eqNullSafe(cut[id_]) & (text_hash(docs["text"]) == cut[key]), "left")
    new = {"text": F.coalesce(kept, docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return both.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


ORACLE = f"""
WITH l AS (SELECT doc_id, text, UNNEST(string_split(text, chr(10))) AS line, UNNEST(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, COALESCE(LAG(md5(line)) OVER (PARTITION BY doc_id ORDER BY i), '') || md5(line) AS pair FROM l),
b AS (SELECT *, CASE WHEN substr(md5(pair), 1, 1) < '{BOUNDARY}' THEN 1 ELSE 0 END AS ends FROM h),
g AS (SELECT *, COALESCE(SUM(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM b),
k AS (SELECT doc_id, c, MIN(i) AS s, COUNT(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM g GROUP BY doc_id, c),
r AS (SELECT *, n >= {LEAST_LINES} AND ROW_NUMBER() OVER (PARTITION BY t ORDER BY doc_id, s) > 1 AS gone FROM k),
f AS (SELECT doc_id, SUM(n) AS n_lines, SUM(CASE WHEN gone THEN n ELSE 0 END) AS n_removed, COUNT(*) FILTER (WHERE gone) AS n_chunks,
  COALESCE(string_agg(t, chr(10) ORDER BY s) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(COALESCE(n_lines, 0) AS BIGINT) AS n_lines, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed,
  COALESCE(n_chunks, 0) AS n_chunks, sha256(COALESCE(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN f USING (doc_id)
"""

ORACLE_PASSAGES = """
WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, UNNEST(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, LEAD(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM l),
r AS (SELECT *, after IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS again FROM p),
g AS (SELECT *, again OR COALESCE(LAG(again) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS gone FROM r),
f AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_removed, COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN f USING (doc_id)
"""
