"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of '>' before it (spaces between them allowed). Lines are normalised (lower case, runs of
anything but letters and digits to one space). A message's passages are, at each level, all its lines of the level together,
its paragraphs (neighbouring lines of one level without a blank one), and its lines; line breaks within a passage are spaces,
so a quote that was wrapped anew is the same passage. Quoted passages are hashed and joined with the first message of the
conversation that wrote such a passage of the same kind itself. A message answers the message that it quotes at its least
quote level that links anywhere: by the largest kind of passage that links, then by the most characters, then the latest.
Threads are read along answers: each message gets its parent, its thread's root, its depth, its position in the
conversation's reply order (by root, then turn; equal turns share one), and its text without quotes.

Originals are grouped by (conversation, kind, hash) with partial aggregation and one row each, so a hot conversation or line
makes no pairs. Roots come by pointer doubling over written tables, in rounds of the logarithm of the longest thread;
positions are counted within ranges of (conversation, root, turn), then over the ranges' totals.

Defined results: null text has no lines and an empty text left; a message without conv_id or turn links to nothing, is its
own root and has no position; rows that share conv_id and turn share parent, root and position; quotes that nobody wrote link
nowhere and still go; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

_QUOTE = r"^[ \t]*>(?:[ \t]*>)*"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[ \t]", ""))


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _QUOTE, "")), r"[^\p{L}\p{N}]+", " "))


LINE, PARAGRAPH, WHOLE = 1, 2, 3


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, kind, level, hash, size for each passage of messages(conv_id, turn, text) that has letters or digits."""
    each = lambda x: F.struct(_level(x).alias("level"), _plain(x).alias("plain"))
    df = messages.select("conv_id", "turn", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), each).alias("l"))
    # a paragraph begins at another level and beside a blank line
    at = lambda i: F.get("l", i)
    begins = lambda i: (i == 0) | (at(i)["level"] != at(i - 1)["level"]) | (at(i)["plain"] == "") | (at(i - 1)["plain"] == "")
    df = df.withColumn("begin", F.filter(F.sequence(F.lit(0), F.size("l") - 1), begins))
    end = lambda k: F.coalesce(F.get("begin", k + 1), F.size("l"))
    plain = lambda lines: F.array_join(F.transform(lines, lambda y: y["plain"]), " ")
    passage = lambda kind, level, text: F.struct(F.lit(kind).alias("kind"), level.alias("level"), text.alias("text"))
    full = F.filter("l", lambda y: y["plain"] != "")
    lines = F.transform(full, lambda y: passage(LINE, y["level"], y["plain"]))
    paragraphs = F.transform("begin", lambda i, k: passage(PARAGRAPH, at(i)["level"], plain(F.slice("l", i + 1, end(k) - i))))
    levels = F.array_distinct(F.transform(full, lambda y: y["level"]))
    whole = F.transform(levels, lambda v: passage(WHOLE, v, plain(F.filter(full, lambda y: y["level"] == v))))
    out = df.select("conv_id", "turn", F.explode(F.concat(lines, paragraphs, whole)).alias("p")).where("p.text != ''")
    return out.select("conv_id", "turn", "p.kind", "p.level", F.xxhash64("p.text", F.length("p.text")).alias("hash"), F.length("p.text").cast("long").alias("size"))


def unquoted(text: Column) -> Column:
    """The lines of level 0, blank lines at the ends left out."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(_QUOTE))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn for the messages that quote another one."""
    found = parsed(messages.where("conv_id IS NOT NULL AND turn IS NOT NULL"))
    key = ["conv_id", "kind", "hash"]
    first = found.where("level = 0").groupBy(*key).agg(F.min("turn").alias("origin"))
    quotes = found.where("level > 0").groupBy(*key, "turn", "level").agg(F.sum("size").alias("size"))
    hits = quotes.join(first, key).where("origin < turn").groupBy("conv_id", "turn", "level", "kind", "origin").agg(F.sum("size").alias("size"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "kind", "size", "origin")).alias("best")
    return hits.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.origin").alias("parent_turn"))


def _positions(known: DataFrame) -> DataFrame:
    """known(conv_id, root_turn, turn, n) with position: one more than the rows before it in its conversation."""
    dealt = known.repartitionByRange("conv_id", "root_turn", "turn").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = before(Window.partitionBy("part", "conv_id").orderBy("root_turn", "turn"))
    totals = dealt.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    totals = totals.select("conv_id", "part", before(Window.partitionBy("conv_id").orderBy("part")).alias("outer"))
    return dealt.withColumn("inner", inner).join(totals, ["conv_id", "part"]).withColumn("position", F.col("inner") + F.col("outer") + 1)


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, depth, position, text (without quotes) for each row of messages."""
    messages = messages.select("conv_id", "turn", "role", "text")
    links = materialise(linked(messages))
    # every link's up is an ancestor, depth steps above; ancestors without a link are roots
    ups = links.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("steps"))
    while True:
        above = ups.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        new = ups.join(above, (ups["conv_id"] == above["c"]) & (ups["up"] == above["t"]), "left")
        new = materialise(new.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("up2").isNotNull().alias("moved")))
        ups = new.select("conv_id", "turn", "up", "steps")
        if new.where("moved").isEmpty():
            break
    found = links.join(ups, ["conv_id", "turn"])
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    known = known.join(found, ["conv_id", "turn"], "left")
    known = _positions(known.select("conv_id", "turn", "n", "parent_turn", F.coalesce("up", "turn").alias("root_turn"), F.coalesce("steps", F.lit(0)).alias("depth")))
    out = messages.join(known, ["conv_id", "turn"], "left")
    root, depth = F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth")
    return out.select("conv_id", "turn", "role", "parent_turn", root, depth, "position", unquoted(F.col("text")).alias("text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, depth, position, text without quotes, for every message."""
    return threads(table(spark, sf_dir, "conversations"))


_LEVEL = r"length(regexp_replace(regexp_extract(line, '^[ \t]*>(?:[ \t]*>)*'), '[ \t]', '', 'g'))"
ORACLE = rf"""
WITH RECURSIVE m AS (SELECT ROW_NUMBER() OVER () AS row, conv_id, turn, string_split(COALESCE(text, ''), chr(10)) AS lines FROM conversations),
l AS (SELECT row, conv_id, turn, UNNEST(lines) AS line, UNNEST(range(len(lines))) AS i FROM m),
p AS (SELECT row, conv_id, turn, i, {_LEVEL} AS level, trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*>(?:[ \t]*>)*', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS plain FROM l),
b AS (SELECT *, CASE WHEN i = 0 OR level <> LAG(level) OVER w OR plain = '' OR LAG(plain) OVER w = '' THEN 1 ELSE 0 END AS begins FROM p WINDOW w AS (PARTITION BY row ORDER BY i)),
g AS (SELECT *, SUM(begins) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS para FROM b),
u AS (SELECT conv_id, turn, 1 AS kind, level, plain FROM p WHERE plain <> ''
  UNION ALL SELECT conv_id, turn, 2, level, string_agg(plain, ' ' ORDER BY i) FROM g WHERE plain <> '' GROUP BY conv_id, turn, row, para, level
  UNION ALL SELECT conv_id, turn, 3, level, string_agg(plain, ' ' ORDER BY i) FROM p WHERE plain <> '' GROUP BY conv_id, turn, row, level),
o AS (SELECT conv_id, kind, plain, MIN(turn) AS origin FROM u WHERE level = 0 AND turn IS NOT NULL GROUP BY conv_id, kind, plain),
q AS (SELECT u.conv_id, u.turn, level, kind, origin, CAST(SUM(length(plain)) AS BIGINT) AS n FROM u JOIN o USING (conv_id, kind, plain) WHERE level > 0 AND origin < u.turn GROUP BY ALL),
k AS (SELECT conv_id, turn, arg_max(origin, (-level, kind, n, origin)) AS parent_turn FROM q GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn, parent_turn AS up, 1 AS depth FROM k UNION ALL SELECT r.conv_id, r.turn, k.parent_turn, r.depth + 1 FROM r JOIN k ON k.conv_id = r.conv_id AND k.turn = r.up),
t AS (SELECT conv_id, turn, MAX(depth) AS depth, arg_max(up, depth) AS root FROM r GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, role, parent_turn, COALESCE(root, c.turn) AS root_turn, CAST(COALESCE(depth, 0) AS BIGINT) AS depth,
  CASE WHEN c.conv_id IS NOT NULL AND c.turn IS NOT NULL THEN RANK() OVER (PARTITION BY c.conv_id, c.turn IS NULL ORDER BY COALESCE(root, c.turn), c.turn) END AS position,
  regexp_replace(array_to_string(list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>(?:[ \t]*>)*')), chr(10)), '^\s+|\s+$', '', 'g') AS text
FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn LEFT JOIN t ON t.conv_id = c.conv_id AND t.turn = c.turn
"""
