"""Trie of conversation prefixes, rolled up in bands of depth.

A node is a distinct sequence of first turns (role, text). Its key is the exclusive or of 2 x 64-bit hashes of (depth, SHA-256
of role and text) along the path, a running total, so even a conversation that holds a third of all turns is keyed in pieces:
places within partitions of one global sort, totals within bands of BAND turns, then a window over the bands' totals.

Sums over subtrees go up in bands. Within a band each node's values go to its ancestors in that band alone, at most BAND;
nodes of one band on one conversation's path are added up before they are sent. The tops of bands, with their band's sums,
then form a trie of 1/BAND of the depth, which is summed in the same way until one band holds it all, and the completed sums
of tops go to their ancestors in the band above. A trie of depth d takes log(d) / log(BAND) rounds and each row goes to at
most BAND ancestors a round.

Digests of members are streamed in order over strings of ids that are joined per partition of a sort, so a node at which a
third of all conversations end is read as a few long strings.

Defined results: rows without conv_id belong to no conversation; null turns come first, turns that share a number are ordered
by role, then text, and rows equal in all are kept as turns of their own; null role or text is empty; a conversation without
turns is a member of the root; an empty table has no node; texts of any length count whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, release, table

#: Depths of one band.
BAND = 64
#: Conversations of a block share the first turns of its first; at most SHARED - 1 of them.
BLOCK, SHARED = 100, 6
KEY = ["depth", "kx", "ky"]


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, part, row, a, b, points) and pieces(conv_id, part, row0, before, n): a turn is the
    row - row0 + before + 1st of its conversation, which has n in all. No window or group holds a whole conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_at"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_at"]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("row"), digest.alias("d"), F.length("text").cast("long").alias("points"))
    turns = materialise(placed.select("conv_id", F.shiftright("row", 33).alias("part"), "row", _half(F.col("d"), 1).alias("a"), _half(F.col("d"), 16).alias("b"), "points"))
    pieces = turns.groupBy("conv_id", "part").agg(F.min("row").alias("row0"), F.count(F.lit(1)).alias("n"))  # mostly one a conversation
    own = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns, materialise(pieces.select("conv_id", "part", "row0", before.alias("before"), F.sum("n").over(own).alias("n")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, a, b, points, is_end: the rebuilt conversations' turns, and a row of depth 0 for each conversation."""
    turns, pieces = ordered_turns(conversations)
    place = F.col("row") - F.col("row0") + F.col("before") + 1
    first = pieces.where((F.col("conv_id") % BLOCK == 0) & (F.col("before") < SHARED))
    heads = turns.where(F.col("conv_id") % BLOCK == 0).join(first, ["conv_id", "part"]).select("conv_id", place.alias("place"), "a", "b", "points").where(F.col("place") < SHARED)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "points"))).alias("head"))
    convs = pieces.where("before = 0").select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")))
    convs = materialise(convs.select("conv_id", "h", "head", F.size("head").alias("n_head"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    whole = pieces.join(convs.select("conv_id", "h", "n_head", "size"), "conv_id")
    own = turns.join(whole, ["conv_id", "part"]).where(place > F.col("h")).select("conv_id", (place - F.col("h") + F.col("n_head")).alias("depth"), "a", "b", "points", "size")
    lent = convs.select("conv_id", "size", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.a", "t.b", "t.points", "size")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("points"), "size")
    out = own.unionByName(lent).unionByName(root)
    return out.select("conv_id", "depth", "a", "b", "points", (F.col("depth") == F.col("size")).alias("is_end"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, band, kx, ky, px, py, points, is_end: each turn's node key and its parent's."""
    hashed = lambda seed: F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "depth", "a", "b")).cast("long")
    rows = turns.withColumns({"band": F.floor(F.col("depth") / BAND).cast("long"), "x": hashed(1), "y": hashed(2)})
    inside = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "band").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    totals = totals.select("conv_id", "band", *[F.coalesce(F.bit_xor(f"t{c}").over(above), F.lit(0)).alias(f"t{c}") for c in "xy"])
    keyed = rows.withColumns({f"k{c}": F.bit_xor(c).over(inside) for c in "xy"}).join(totals, ["conv_id", "band"])
    keyed = keyed.withColumns({f"k{c}": F.col(f"k{c}").bitwiseXOR(F.col(f"t{c}")) for c in "xy"})
    return keyed.select("conv_id", "depth", "band", *KEY[1:], *[F.col(f"k{c}").bitwiseXOR(F.col(c)).alias(f"p{c}") for c in "xy"], "points", "is_end")


def _deepest(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]


def subtree_sums(steps: DataFrame, nodes: DataFrame, values: list[str]) -> DataFrame:
    """depth, kx, ky, values of each node of nodes(depth, kx, ky, rep, values), summed over its subtree.

    steps(conv_id, depth, kx, ky) are all conversations' paths; rep is a member of the node, the same all the way down for as
    long as it is a member of the smallest id.
    """
    banded = steps.select("conv_id", *KEY, F.floor(F.col("depth") / BAND).cast("long").alias("band"))
    reps = nodes.select(F.col("rep").alias("conv_id"), "depth", *values, F.lit(True).alias("is_rep"))
    below = Window.partitionBy("conv_id", "band").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = banded.join(reps, ["conv_id", "depth"], "left")
    sent = held.select(*KEY, F.max("is_rep").over(below).alias("any"), *[F.sum(v).over(below).alias(v) for v in values]).where("any")
    sums = materialise(sent.groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values]))
    if _deepest(nodes) < BAND:
        return sums
    top = F.col("depth") % BAND == 0
    level = (F.col("depth") / BAND).cast("long").alias("depth")
    tops = sums.where(top).join(nodes.where(top).select(*KEY, "rep"), KEY).select(level, "kx", "ky", "rep", *values)
    tops = materialise(tops)
    done = subtree_sums(steps.where(top).select("conv_id", level, "kx", "ky"), tops, values)
    done = done.join(tops.select(*KEY, "rep"), KEY).where("depth > 0").select(F.col("rep").alias("conv_id"), (F.col("depth") - 1).alias("band"), *values)
    more = done.join(banded, ["conv_id", "band"]).groupBy(*KEY).agg(*[F.sum(v).alias(f"{v}_more") for v in values])
    return sums.join(more, KEY, "left").select(*KEY, *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values])


def member_digests(ends: DataFrame) -> DataFrame:
    """depth, kx, ky, ends_sha256 over the ascending, comma-joined conv_ids of ends(depth, kx, ky, conv_id)."""
    dealt = ends.repartitionByRange("kx", "ky", "depth", "conv_id")
    parts = dealt.groupBy(*KEY, F.spark_partition_id().alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select(*KEY, F.col("ids")[0].alias("first"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, sha = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key != open_key:
                    if sha is not None:
                        out.append((*open_key, sha.hexdigest()))
                    open_key, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield made(out)
        if sha is not None:
            yield made([(*open_key, sha.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], [*KEY, "ends_sha256"])

    ordered = parts.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return ordered.mapInArrow(run, "depth long, kx long, ky long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    steps = materialise(paths(rebuilt(conversations)))
    nodes = steps.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.count_if("is_end").alias("n_ends"), F.max("points").alias("points"))
    leaf, saved = (F.col("n_ends") == F.col("n_convs")).cast("long"), (F.col("n_convs") - 1) * F.col("points")
    nodes = materialise(nodes.select(*KEY, "rep", "n_convs", leaf.alias("n_leaves"), saved.alias("saved_tokens")))
    # the step of each node on its smallest member's path, and whether that member is also its parent's
    along = Window.partitionBy("conv_id", "band").orderBy("depth")
    reps = nodes.select(F.col("rep").alias("conv_id"), "depth", F.lit(True).alias("is_rep"))
    marked = steps.select("conv_id", "depth", "band", *KEY[1:], "px", "py").join(reps, ["conv_id", "depth"], "left")
    marked = materialise(marked.withColumn("same", F.lag("is_rep").over(along)).where("is_rep").drop("is_rep", "band"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("kx"), F.col("py").alias("ky")]
    children = marked.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    # every conversation's first own node may hang on the root or another hot node; the root is one row, AQE splits the rest
    root = nodes.where("depth = 0").agg(F.min("rep").alias("root"))
    told = marked.where("depth > 1 AND same IS NULL").select("conv_id", F.col("depth").alias("d"), *up).join(nodes.select(*KEY, F.col("rep").alias("parent")), KEY)
    told = materialise(told.select("conv_id", F.col("d").alias("depth"), "parent"))
    parents = marked.where("depth > 1").select("conv_id", "depth", "same").join(told, ["conv_id", "depth"], "left")
    parents = parents.select(F.col("conv_id").alias("rep"), "depth", F.coalesce("parent", "conv_id").alias("parent"))
    sums = subtree_sums(steps, nodes.select(*KEY, "rep", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    out = nodes.select(*KEY, "rep", "n_convs").join(sums, KEY).join(children, KEY, "left").join(member_digests(steps.where("is_end").select(*KEY, "conv_id")), KEY, "left")
    out = out.join(parents, ["rep", "depth"], "left").crossJoin(F.broadcast(root))  # one row
    parent = F.when(F.col("depth") == 1, F.col("root")).when(F.col("depth") > 1, F.col("parent"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every node of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: crc32 bit by bit over the decimal digits; each node's ancestors are listed whole, as no band is needed at this size.
ORACLE = """
WITH t AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, c.h, COUNT(t.place) AS lent FROM c LEFT JOIN t ON t.conv_id = c.base AND t.place <= c.h GROUP BY ALL),
r AS (SELECT c.conv_id, t.place AS depth, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT t.conv_id, t.place - s.h + s.lent, t.role, t.text FROM t JOIN s USING (conv_id) WHERE t.place > s.h),
l AS (SELECT c.conv_id, COALESCE(MAX(r.depth), 0) AS size FROM c LEFT JOIN r USING (conv_id) GROUP BY 1),
k AS (SELECT conv_id, 0 AS depth, '' AS key, 0 AS points FROM c
  UNION ALL SELECT conv_id, depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth), length(text) FROM r),
n AS (SELECT depth, sha256(key) AS key, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MAX(points) AS points,
    COUNT(*) FILTER (WHERE depth = size) AS n_ends, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size) AS ends
  FROM k JOIN l USING (conv_id) GROUP BY ALL),
p AS (SELECT n.*, k.depth AS up, sha256(k.key) AS up_key FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth),
a AS (SELECT up AS depth, up_key AS key, SUM(CASE WHEN n_ends = n_convs THEN 1 ELSE 0 END) AS n_leaves, SUM((n_convs - 1) * points) AS saved,
    COUNT(*) FILTER (WHERE depth = up + 1) AS n_children FROM p GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, a.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
  CAST(a.saved AS BIGINT) AS saved_tokens, sha256(COALESCE(n.ends, '')) AS ends_sha256
FROM n JOIN a USING (depth, key) LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth AND p.up = n.depth - 1 LEFT JOIN n m ON m.depth = p.up AND m.key = p.up_key
"""
