"""MinHash near-duplicate detection with odd sketches.

A document's set is its distinct shingles of words; documents link if their sets' Jaccard similarity is THRESHOLD per cent
or more. Documents of one set form a class, whose member of smallest doc_id stands for it.

1. BANDS bands of ROWS minimum hashes each put classes into buckets: at the threshold two classes share no bucket with a
   chance below 3e-6, at any higher similarity with less. A bucket gives one row per member, the edge to its smallest
   member; what hangs together by such edges is a cluster, and no link leaves a cluster but by that chance.
2. The texts of classes in clusters are read once more, for their whole sets and odd sketches (SAMPLES minimum hashes folded
   into a parity bitmap, whose differing bits count the differing samples).
3. Clusters are settled in groups of bounded bytes of sets: small clusters several at a time, a large one in tiles. Within
   a group, pairs of different components whose sketches put their similarity above MARGIN (five standard deviations below
   the threshold) are confirmed on the whole sets, and a link that joins two components is the only thing that comes out: a
   group of n members makes n - 1 rows at most, however many of its pairs are links.
4. The tiles of a large cluster all hold the same few anchors, so that most of it is one component after step 3. Members
   outside the cluster's largest component are then held against all tiles in the same way, and nothing else is.
Components come from rounds of minimum labels over written tables.

Defined results: empty or null texts have no shingles and no links; rows that share a doc_id are one document with all their
links; a row without doc_id has no links, no component and is kept; an empty table gives an empty result; other columns are
not looked at; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, materialise, release
from .shingles import mix, shingle_sets, slices

THRESHOLD, BANDS, ROWS, SAMPLES, SKETCH_BITS, MARGIN = 80, 42, 6, 756, 2048, 0.72
WORDS_OP, WORDS_STAGE = 2, 5
#: Bytes of sets of a large cluster that are settled at a time, about, and members of it that every tile holds, about; small
#: clusters share groups of a BINS-th of that.
TILE_BYTES, ANCHORS, BINS = 4_000_000, 256, 8
#: Shingles of candidates that are looked up at a time.
_LOOKUP = 2_000_000
_RNG = np.random.default_rng(11)
_A, _B = (_RNG.integers(0, 2**32, (2, SAMPLES), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def most_bits(samples: int, bits: int, margin: float) -> int:
    """Bits in which sketches may differ: what sets of the margin's similarity are expected to give."""
    return round(bits / 2 * (1 - math.exp(-2 * 2 * samples * (1 - margin) / bits)))


def min_hashes(shingles: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    low = np.full(samples, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 128):
        np.minimum(low, (x[at : at + 128, None] * _A[:samples] + _B[:samples]).min(0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, from the band's number and its minimum hashes; low is (sets, BANDS * ROWS or more)."""
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(low), BANDS))
    bands = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j] + np.uint64(j + 1))
    return keys.view(np.int64)


def odd_sketches(low: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """(sets, size / 64) parity bitmaps of the samples (place, minimum hash)."""
    places = mix((np.arange(low.shape[1], dtype=np.uint64) << np.uint64(32)) + low.astype(np.uint64)) % np.uint64(size)
    bits = np.zeros((len(low), size), np.uint8)
    np.add.at(bits, (np.arange(len(low))[:, None], places.astype(np.int64)), 1)
    return np.packbits(bits & 1, axis=1).view(np.int64)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2): two 64-bit sums over the mixed shingles of each set."""
    other = np.uint64(0x5851F42D4C957F2D)
    both = [(np.add.reduce(mix(s)), np.add.reduce(mix(s ^ other))) for s in sets]
    return np.array(both, np.uint64).reshape(-1, 2).view(np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    starts = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
    return pa.ListArray.from_arrays(starts, pa.array(rows.ravel()))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (digest of the set), keys per row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, words)
                low = np.array([min_hashes(s, BANDS * ROWS) for s in sets], np.uint32)
                full = np.array([len(s) for s in sets], np.int64)
                keys = np.where(full[:, None] > 0, band_keys(low), 0)
                digest = digests(sets)
                columns = [pa.array(full), pa.array(digest[:, 0]), pa.array(digest[:, 1]), _lists(keys)]
                ids = batch.column("doc_id").slice(at, len(sets))
                yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_shingles", "s1", "s2", "keys"])
                at += len(sets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, s1 long, s2 long, keys array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def whole_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """cluster, rep, s1, s2, sketch, shingles (the sorted set, as bytes) for members(s1, s2, rep, cluster).

    The texts come from the documents that stand for them; a document whose text has another set is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, words)
                part = batch.slice(at, len(sets)).drop_columns(["text"])
                at += len(sets)
                wanted = np.stack([part.column("s1").to_numpy(), part.column("s2").to_numpy()], 1)
                own = np.flatnonzero((digests(sets) == wanted).all(1))
                if not len(own):
                    continue
                sketch = odd_sketches(np.array([min_hashes(sets[i]) for i in own], np.uint32))
                columns = [pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([sets[i].tobytes() for i in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(own)).columns, *columns], [*part.schema.names, "sketch", "shingles"])

    # always by a shuffle: the classes in clusters grow with the documents
    both = docs.join(members.hint("merge"), docs["doc_id"] == members["rep"]).select("cluster", "rep", "s1", "s2", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"cluster long, rep {kind}, s1 long, s2 long, sketch binary, shingles binary")


def settle(cluster: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], label: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of rows of one cluster that each join two components; label holds the rows' components at the start.

    Rows of one cluster stand together. A row that asks is held against all rows of its cluster, those before it that ask
    as well left out.
    """
    size = np.array([len(s) for s in sets], np.int64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles of one row alone are in no intersection
    shared = count[code] > 1
    upto = np.concatenate([[0], np.cumsum(shared)])
    ends = upto[np.cumsum(size)]
    starts = np.concatenate([[0], ends[:-1]])
    code = code[shared]
    mark = np.zeros(len(count), bool)
    label, most, out = label.copy(), most_bits(SAMPLES, SKETCH_BITS, MARGIN), []
    first = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(cluster)], strict=True):
        for i in (lo + np.flatnonzero(asks[lo:hi])).tolist():
            rest = lo + np.flatnonzero(label[lo:hi] != label[i])
            rest = rest[(rest > i) | ~asks[rest]]
            rest = rest[100 * np.minimum(size[rest], size[i]) >= THRESHOLD * np.maximum(size[rest], size[i])]
            rest = rest[np.bitwise_count(sketch[rest] ^ sketch[i]).sum(1, dtype=np.int64) <= most]
            if not len(rest):
                continue
            own = code[starts[i] : ends[i]]
            mark[own] = True
            held = ends[rest] - starts[rest]
            for part in np.split(rest, np.flatnonzero(np.diff(np.cumsum(held) // _LOOKUP)) + 1):
                n = ends[part] - starts[part]
                stop = np.cumsum(n)
                flat = np.arange(stop[-1]) + np.repeat(starts[part] - (stop - n), n)
                hits = np.concatenate([[0], np.cumsum(mark[code[flat]])])
                inter = hits[stop] - hits[stop - n]
                links = part[100 * inter >= THRESHOLD * (size[i] + size[part] - inter)]
                for j in links.tolist():
                    if label[j] != label[i]:
                        out.append((i, j))
                        label[lo:hi][label[lo:hi] == label[j]] = label[i]
            mark[own] = False
    return out


def _settled(table: pa.Table) -> pa.Table:
    """(a, b): links between the representatives in a group's rows; a row repeated in both roles is in one component."""
    table = table.sort_by("cluster")
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(table), -1)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    # rows that share a component, by the smallest row of it
    names = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    cluster = table.column("cluster").to_numpy()
    found = settle(cluster, sketch, sets, names, table.column("asks").to_numpy())
    rep = table.column("rep")
    i, j = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
    return pa.table({"a": rep.take(i), "b": rep.take(j)})


def _links(groups: DataFrame, kind: str) -> DataFrame:
    """Settle groups(g1, g2, g3, cluster, rep, component, asks, sketch, shingles)."""
    return groups.groupBy("g1", "g2", "g3").applyInArrow(_settled, f"a {kind}, b {kind}").where("a != b")


def components(links: DataFrame) -> DataFrame:
    """id, component for every end of links(a, b): the smallest id that it reaches."""
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"])
        step = materialise(step.select("id", F.least("component", "near").alias("next"), F.col("component").alias("before")))
        jump = step.select(F.col("id").alias("at"), F.col("next").alias("beyond"))
        new = step.join(jump, step["next"] == jump["at"], "left")
        new = materialise(new.select("id", F.least("next", F.coalesce("beyond", "next")).alias("component"), "before"))
        release(labels, step)
        if new.where("component != before").isEmpty():
            release(edges)
            return new.select("id", "component")
        labels = new


def _share(c: str, seed: int, n: Column | int) -> Column:
    """A number below n, by the value's hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(c)), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def cluster_links(sets: DataFrame, tile_bytes: int = TILE_BYTES, anchors: int = ANCHORS) -> DataFrame:
    """(a, b): links that join all components of the clusters in sets(cluster, rep, s1, s2, sketch, shingles)."""
    kind = sets.schema["rep"].dataType.simpleString()
    sized = materialise(sets.groupBy("cluster").agg(F.sum(F.length("shingles")).alias("bytes"), F.count("*").alias("n")))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    bins = max(1, -(-total * BINS // tile_bytes))
    large = sized.where(F.col("bytes") > tile_bytes)
    large = large.select("cluster", F.ceil(F.col("bytes") / tile_bytes).cast("int").alias("tiles"), F.ceil(F.col("n") / anchors).cast("int").alias("nth"))
    dealt = sets.join(large, "cluster", "left").withColumns({"component": F.col("rep"), "asks": F.lit(True)})
    whole = ["cluster", "rep", "component", "asks", "sketch", "shingles"]
    small = dealt.where("tiles IS NULL").select(F.lit(0).alias("g1"), _share("cluster", 1, bins).alias("g2"), F.lit(0).alias("g3"), *whole)
    tiled = dealt.where("tiles IS NOT NULL")
    in_all = _share("s1", 2, F.col("nth")) == 0
    own = F.when(in_all, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(_share("s1", 3, F.col("tiles"))))
    tiled = tiled.select(F.lit(1).alias("g1"), F.xxhash64("cluster").alias("g2"), F.explode(own).alias("g3"), *whole)
    columns = [F.col(c).cast("long").alias(c) for c in ("g1", "g2", "g3")]
    links = materialise(_links(small.select(*columns, *whole).unionByName(tiled.select(*columns, *whole)), kind))
    if large.isEmpty():
        return links
    labels = materialise(components(links))
    part = sets.join(large.select("cluster"), "cluster").join(labels, sets["rep"] == labels["id"], "left")
    part = part.select("cluster", "rep", "s1", "sketch", "shingles", F.coalesce("component", "rep").alias("component"))
    counts = part.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    main = F.max_by("component", F.struct("n", "component")).alias("main")
    left = counts.groupBy("cluster").agg(main, F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("n").alias("most"))
    left = materialise(left.where("n > most"))
    half = F.lit(tile_bytes // 2)
    tiles = left.select("cluster", "main", F.ceil(F.col("bytes") / half).cast("int").alias("qs"))
    rows = part.join(tiles, "cluster")
    asking = rows.where("component != main").withColumn("asks", F.lit(True))
    # as many groups of asking rows as groups of all rows, at most
    askers = asking.groupBy("cluster").agg(F.ceil(F.sum(F.length("shingles")) / half).cast("int").alias("ps"))
    rows = rows.join(askers, "cluster").withColumns({"p": _share("s1", 4, F.col("ps")), "q": _share("s1", 5, F.col("qs"))})
    one = rows.where("component != main").select(F.col("p").alias("g1"), _each("qs").alias("g2"), F.xxhash64("cluster").alias("g3"), "cluster", "rep", "component", F.lit(True).alias("asks"), "sketch", "shingles")
    two = rows.select(_each("ps").alias("g1"), F.col("q").alias("g2"), F.xxhash64("cluster").alias("g3"), "cluster", "rep", "component", F.lit(False).alias("asks"), "sketch", "shingles")
    return links.unionByName(_links(one.unionByName(two), kind))


def stars(classes: DataFrame) -> DataFrame:
    """(a, b): edges that join all of classes(s1, keys) that hang together by buckets.

    A class goes to the smallest hub of its buckets, and a bucket then joins the hubs that its members went to: a group
    whose members all meet one of them makes a row a member, not one for each of its buckets.
    """
    banded = classes.select("s1", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("s1").alias("hub"), F.max("s1").alias("last")).where("hub < last").select("key", "hub")
    shared = materialise(banded.join(hubs, "key"))
    near = materialise(shared.groupBy("s1").agg(F.min("hub").alias("near")))
    gone = materialise(shared.select("key", "s1").join(near, "s1").select("key", "near"))
    firsts = gone.groupBy("key").agg(F.min("near").alias("a"), F.max("near").alias("last")).where("a < last").select("key", "a")
    between = gone.join(firsts, "key").where("near != a").select("a", F.col("near").alias("b"))
    out = materialise(near.where("near != s1").select(F.col("near").alias("a"), F.col("s1").alias("b")).union(between).distinct())
    release(shared, near, gone)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS_OP, tile_bytes: int = TILE_BYTES, anchors: int = ANCHORS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    signed = materialise(signatures(docs, words))
    full = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    by_set = ["s1", "s2", "n_shingles"]
    classes = materialise(full.groupBy(*by_set).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    # clusters go by half of the digest: a chance meeting only puts two classes into one cluster
    clusters = components(stars(classes))
    members = classes.join(clusters, classes["s1"] == clusters["id"]).select("s1", "s2", "rep", F.col("component").alias("cluster"))
    sets = materialise(whole_sets(docs, members, words).dropDuplicates(["s1", "s2"]))
    links = materialise(cluster_links(sets, tile_bytes, anchors))
    release(sets)
    # a doc_id of several texts is one document: it joins its classes
    split = full.select("doc_id", *by_set).distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = full.join(split, "doc_id", "left_semi").join(classes, by_set).where("doc_id != rep")
    links = links.unionByName(again.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    labels = components(links).select(F.col("id").alias("rep"), "component")
    found = signed.select("doc_id", *by_set).join(classes.drop("keys"), by_set, "left").join(labels, "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles, with the columns of docs."""
    gone = near_duplicates(docs.select("doc_id", "text"), WORDS_STAGE).where("NOT kept").select("doc_id").distinct()
    name = fresh(docs, "_gone_id")[0]
    gone = gone.select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, sh, len(sh) AS n FROM s),
x AS (SELECT doc_id, n, UNNEST(sh) AS t FROM n),
rare AS (SELECT t, COUNT(*) AS f FROM x GROUP BY t HAVING COUNT(*) > 1),
p AS (SELECT doc_id, n, t, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY COALESCE(f, 1), t) AS pos FROM x LEFT JOIN rare USING (t)),
pre AS (SELECT doc_id, n, t FROM p WHERE pos <= n - CAST(CEIL(0.8 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * LEAST(a.n, b.n) >= 80 * GREATEST(a.n, b.n)),
e AS (SELECT a, b FROM (SELECT c.a, c.b, len(list_intersect(p.sh, q.sh)) AS i, p.n + q.n AS t FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b) WHERE 100 * i >= 80 * (t - i)),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS seen FROM n UNION SELECT r.id, both_.b FROM r JOIN both_ ON r.seen = both_.a),
k AS (SELECT id, MIN(seen) AS component_id FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k ON k.id = n.doc_id
"""
