"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources, in code-point order with null last, have weights 1, 2, 3, 1, 2, 3, ... that share the corpus's words. A source's
target stops at MAX_PASSES times its size; the excess is shared by weight among the others until none is above.

The schedule has N = 2**m slots. Slot k is the van der Corput point v(k) = reverse of k's m bits over N; mapped through the
cumulative targets it falls on one source. As v permutes the multiples of 1/N, a source with share p gets p*N slots to
within one, and every prefix of the schedule holds the shares to within O(log N) slots. A slot's rank within its source has
a closed form (bits of k against a residue class), so no window over a source's slots is needed, however hot it is.
A source's documents, in the order of md5(doc_id and md5 of the text), form one stream of words, repeated MAX_PASSES times and cut into blocks
of B = ceil(words / N) words; the slot of rank r takes the block r. The join of slots with blocks gives spans:
(slot, source, document, pass, first word, words).

Defined results: null text or text without words has size 0 and takes 0 words; null sources form one source; rows that share
a doc_id stay separate rows; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, documents, fresh, materialise

#: Slots are at least 2**LEAST_BITS, and as many more as keep blocks at BLOCK_TOKENS words at most.
LEAST_BITS, BLOCK_TOKENS, MAX_PASSES = 16, 4096, 3
#: Slots made by one task's row at a time.
_CHUNK = 4096
#: Tasks that make slots, at most.
MOST_PARTS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def stream_key(docs: DataFrame) -> Column:
    """Orders a source's stream; the text takes part, so that rows of one doc_id don't stand together."""
    text = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), text).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, k, h): k orders a source's stream, and h is its first 8 hex digits as a number."""
    key = stream_key(docs)
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("k"), F.conv(F.substring(key, 1, 8), 16, 10).cast("long").alias("h"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight, target, lo, hi): hi - lo slots for each source, by the running sum of targets."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    cap = F.lit(MAX_PASSES) * F.col("source_size")
    filling = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before, all_rows = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(all_rows)
    left = total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.select("source", "source_size", "weight", cap.alias("cap"), total.alias("total"), (left / weight_left).alias("level"), F.row_number().over(filling).alias("nth"))
    # in order of cap/weight, sources are full up to the first whose cap is above its share of what is left
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("nth"))).over(all_rows)
    level = F.min(F.when(F.col("nth") == F.col("first"), F.col("level"))).over(all_rows)
    per = per.withColumn("first", first).withColumn("final", level)
    full = F.col("first").isNull() | (F.col("nth") < F.col("first"))
    return per.select("source", "source_size", "weight", "total", F.round(F.when(full, F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")), 6).alias("target"))


def _slots(spread: DataFrame, bits: int) -> DataFrame:
    """(source, slot, rank): every slot of the schedule with its rank among its source's slots."""
    chunked = spread.where("hi > lo").select("source", "lo", "hi", F.explode(F.expr(f"sequence(lo, hi - 1, {_CHUNK}L)")).alias("at"))
    chunked = chunked.repartition(max(1, min(MOST_PARTS, (1 << bits) // _CHUNK)), F.col("source"), F.col("at"))
    points = chunked.select("source", "lo", "hi", F.explode(F.expr(f"sequence(at, least(at + {_CHUNK - 1}L, hi - 1))")).alias("j"))
    swap = F.col("j")
    for mask, by in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4), (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16)):
        swap = F.shiftright(swap, by).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(swap.bitwiseAND(F.lit(mask)), by))
    swap = F.shiftrightunsigned(swap, 32).bitwiseOR(F.shiftleft(swap, 32))
    points = points.withColumn("slot", F.shiftrightunsigned(swap, 64 - bits))
    # slots before this one that share its bits above b and have bit b clear: their points are one residue class
    terms = []
    for b in range(bits):
        residue, by = f"(j & {(1 << (bits - 1 - b)) - 1}L)", bits - b
        terms.append(f"((shiftright(slot, {b}) & 1L) * (shiftright(hi - 1L - {residue}, {by}) - shiftright(lo - 1L - {residue}, {by})))")
    rank = F.expr(" + ".join(terms))
    return points.select("source", "slot", rank.cast("long").alias("rank"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).

    rows: doc_id, k, source, size, source_size, target, row (its place in its source's stream, unique there), at (words before
    it). spans: source, row, slot, pass, start, words: what each slot takes, start counted within the document.
    """
    sized = materialise(sizes(docs))
    per = materialise(targets(sized))
    said = per.agg(F.first("total").alias("total")).first()
    total = int(said["total"] or 0)
    count = sized.count()
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, total / BLOCK_TOKENS))))
    block = max(1, math.ceil(total / (1 << bits)))
    ends = F.sum("target").over(Window.orderBy(F.col("source").isNull(), "source"))
    edge = lambda c: F.least(F.lit(1 << bits), F.floor(c * F.lit(float(1 << bits)) / F.greatest(F.col("total"), F.lit(1)).cast("double") + F.lit(1e-6))).cast("long")
    spread = per.withColumn("end", ends).select("source", "source_size", "target", edge(F.col("end") - F.col("target")).alias("lo"), edge(F.col("end")).alias("hi"))
    spread = spread.withColumn("quota", F.least((F.col("hi") - F.col("lo")) * F.lit(block), F.floor("target"))).withColumn("tag", F.col("source").isNull())
    # places within streams: within a bucket of md5, then buckets before it; about as many buckets as rows in each
    buckets = 1 << math.ceil(math.log2(max(1, math.isqrt(count))))
    cut = sized.withColumn("bucket", F.floor(F.col("h") * F.lit(buckets) / F.lit(1 << 32)).cast("int"))
    inner = Window.partitionBy("source", "bucket").orderBy("k", "doc_id", "size")
    held = cut.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.count("*").alias("rows"))
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("source", "bucket", F.coalesce(F.sum("held").over(outer), F.lit(0)).alias("words_before"), F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("rows_before"))
    held = held.alias("b").join(spread.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "source_size", "target", "quota")
    placed = cut.withColumn("nth", F.row_number().over(inner)).withColumn("upto", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    rows = placed.alias("p").join(held.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket")))
    rows = materialise(rows.select("doc_id", "k", "p.source", "size", "source_size", "target", "quota", (F.col("rows_before") + F.col("nth")).alias("row"), (F.col("words_before") + F.col("upto") - F.col("size")).alias("at")))
    begin = F.col("at") + F.col("pass") * F.col("source_size")
    part = rows.where("size > 0").select("source", "row", "size", "quota", "at", "source_size", F.explode(F.array(*[F.lit(i) for i in range(MAX_PASSES)])).alias("pass"))
    part = part.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), F.col("quota"))).where("end > begin")
    pieces = part.select("source", "row", "pass", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    slots = _slots(spread, bits).alias("t")
    spans = pieces.alias("q").join(slots, F.col("q.source").eqNullSafe(F.col("t.source")) & (F.col("q.block") == F.col("t.rank")))
    start = F.greatest(F.col("begin"), F.col("block") * F.lit(block))
    spans = spans.select("q.source", "row", "slot", "pass", (start - F.col("begin")).alias("start"), (F.least("end", (F.col("block") + 1) * F.lit(block)) - start).alias("words"))
    return rows, spans


def mix(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, k (its stream_key), source, size, source_size, target, taken, first_slot, row."""
    rows, spans = plan(docs)
    base = rows.select("source", "row", "doc_id", "k", "size", "source_size", "target", F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("slot"))
    none = F.lit(None)
    taken = spans.select("source", "row", none.cast(base.schema["doc_id"].dataType).alias("doc_id"), none.cast("string").alias("k"), none.cast("long").alias("size"), none.cast("long").alias("source_size"), none.cast("double").alias("target"), "words", "slot")
    both = base.unionByName(taken).groupBy("source", "row")
    first = lambda c: F.max(c).alias(c)
    return both.agg(first("doc_id"), first("k"), first("size"), first("source_size"), first("target"), F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the documents that the mix takes, with their taken words and the slot where each first comes.

    Rows that repeat a doc_id and text are mixed as rows of their own; each of them gets their mean of taken words.
    """
    key, k2, id_ = fresh(docs, "_mix_key", "_mix_key2", "_mix_id")
    names = fresh(docs, "mix_taken", "mix_first_slot", "mix_target")
    keyed = mix(docs.select("doc_id", "text", "source"))
    taken = keyed.groupBy("doc_id", "k", "source").agg((F.sum("taken") / F.count("*")).alias("taken"), F.min("first_slot").alias("first_slot"), F.max("target").alias("target"))
    taken = taken.where("taken > 0").select(
        F.col("doc_id").alias(id_), F.col("k").alias(k2), F.col("source").alias(key), F.round("taken").cast("long").alias(names[0]),
        F.col("first_slot").alias(names[1]), F.col("target").alias(names[2]),
    )
    same = docs["doc_id"].eqNullSafe(taken[id_]) & (stream_key(docs) == taken[k2]) & docs["source"].eqNullSafe(taken[key])
    return docs.join(taken, same).drop(id_, k2, key)


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, ''))) AS k FROM documents),
per AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM per),
filling AS (
  SELECT *, 3 * source_size AS cap, SUM(source_size) OVER () AS total,
    ROW_NUMBER() OVER w AS nth,
    (SUM(source_size) OVER () - COALESCE(SUM(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(SUM(weight) OVER () - COALESCE(SUM(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight, source IS NULL, source)),
found AS (SELECT *, MIN(CASE WHEN cap > level * weight THEN nth END) OVER () AS first FROM filling),
leveled AS (SELECT *, MIN(CASE WHEN nth = first THEN level END) OVER () AS final FROM found),
aimed AS (SELECT source, source_size, total,
    ROUND(CASE WHEN first IS NULL OR nth < first THEN CAST(cap AS DOUBLE) ELSE final * weight END, 6) AS target FROM leveled),
dims AS (SELECT *, pow(2, GREATEST({LEAST_BITS}, CEIL(LOG2(GREATEST(1, total / {BLOCK_TOKENS}.0))))) AS n,
    SUM(target) OVER (ORDER BY source IS NULL, source) AS upto FROM aimed),
spread AS (SELECT source, source_size, target,
    LEAST((LEAST(n, FLOOR(upto * n / GREATEST(total, 1) + 1e-6)) - LEAST(n, FLOOR((upto - target) * n / GREATEST(total, 1) + 1e-6)))
          * GREATEST(1, CEIL(total / n)), FLOOR(target)) AS quota FROM dims),
placed AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.quota,
    SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS pos
  FROM sized s JOIN spread p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(GREATEST(0, LEAST(size, quota - pos)) + GREATEST(0, LEAST(size, quota - source_size - pos))
       + GREATEST(0, LEAST(size, quota - 2 * source_size - pos)) AS BIGINT) AS taken FROM placed
"""
