"""Exact top-k inner-product search: tiled matrix products, partial selection per tile, tree merging of top lists.

A component x becomes floor(64 * x), x as double. Queries are the rows whose vec_id is divisible by QUERY_EVERY, candidates
all rows but the query's own. Rows are dealt to shards by a row number, queries to groups; a tile is one shard against one
group, both of TILE_BYTES at most about, so no task's memory grows with the table, and the table is shuffled once for each
group of queries. Products are made in the narrowest floats that hold them exactly. Each tile returns each query's k best,
and lists are merged FAN_IN at a time per query until one is left.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
vec_id; rows that share a vec_id all take part, as candidates and, each with a list of its own, as queries; products are
taken among vectors of one length; equal scores go to the smaller vec_id; fewer than k candidates give as many rows; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

K, QUERY_EVERY, SCALE = 20, 20, 64
#: Bytes of vectors of a shard or a group of queries, scores held at a time, and lists merged at a time.
TILE_BYTES, TILE_SCORES, FAN_IN = 16_000_000, 4_000_000, 8
#: Products and sums below these are exact integers in floats of 4 and 8 bytes.
_EXACT = ((np.float32, 2.0**24), (np.float64, 2.0**53))
#: A shard has fewer rows than this, and scores below the other bound can be ordered together with a row's place.
_PLACES, _ORDERED = 1 << 20, 2.0**42


def _wide(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products of integers of any size, held to the range of a long."""
    a, b = (np.array([[int(x) for x in v] for v in m], object).reshape(m.shape) for m in (queries, rows))
    return np.clip(a @ b.T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best_of_tile(
    queries: np.ndarray, rows: np.ndarray, query_rows: np.ndarray, row_numbers: np.ndarray, row_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each query places in rows and scores (-1 and 0 beyond the last) of the k best, own rows left out.

    row_ids ascend, so that of equal scores the first has the smallest id.
    """
    bound = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    kind = next((kind for kind, most in _EXACT if bound < most), None)
    if kind is not None:
        queries, rows = queries.astype(kind), rows.astype(kind)
    n, order = len(rows), np.argsort(row_numbers)
    at = np.searchsorted(row_numbers[order], query_rows)
    own = np.where((at < n) & (row_numbers[order[np.minimum(at, n - 1)]] == query_rows), order[np.minimum(at, n - 1)], -1)
    place, score = np.full((len(queries), k), -1, np.int64), np.zeros((len(queries), k), np.int64)
    step = max(1, TILE_SCORES // n)
    for lo in range(0, len(queries), step):
        some = slice(lo, lo + step)
        scores = (queries[some] @ rows.T).astype(np.int64) if kind is not None else _wide(queries[some], rows)
        mine = np.flatnonzero(own[some] >= 0)
        take = min(k, n)
        if bound < _ORDERED:
            keys = scores * _PLACES + (_PLACES - 1 - np.arange(n))
            keys[mine, own[some][mine]] = -(2**63)
            keys = np.partition(keys, n - take, axis=1)[:, n - take :]
            keys = np.sort(keys, axis=1)[:, ::-1]
            found, values = _PLACES - 1 - keys % _PLACES, keys // _PLACES
            found[keys == -(2**63)] = -1
        else:
            lowest = np.where(np.arange(n) == own[some][:, None], 1, 0)
            found = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, lowest), axis=1)[:, :take]
            values = np.take_along_axis(scores, found, 1)
            found[np.take_along_axis(lowest, found, 1) == 1] = -1
        place[some, :take], score[some, :take] = found, values
    return place, score


def _tile(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Lists of one tile: left has rid, vec_id, v of the shard, right query, q of the queries."""
    left = left.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
    matrix = lambda t, c: np.stack([np.asarray(x) for x in t.column(c).to_pylist()])
    ids, query = left.column("vec_id").to_numpy(), right.column("query").to_numpy()
    if len(ids) and len(query):
        place, score = best_of_tile(matrix(right, "q"), matrix(left, "v"), query, left.column("rid").to_numpy(), ids, k)
    else:
        place, score = np.zeros((0, k), np.int64), np.zeros((0, k), np.int64)
        right = right.slice(0, 0)
    some = place >= 0
    starts = pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]), pa.int32())
    lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int64())) for x in (ids[place[some]], score[some])]
    return pa.table({"query": right.column("query"), "query_id": right.column("query_id"), "shard": right.column("shard"), "ids": lists[0], "scores": lists[1]})


def search(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k best among vectors(vec_id, embedding)."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    # as doubles, so that a component beyond the range of a long stays whole; written, so that row numbers stay
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    rid = F.monotonically_increasing_id().alias("rid")
    rows = materialise(rows.select(rid, F.col("vec_id").cast("long"), v.alias("v"), F.size("embedding").alias("dim")))
    queries = rows.where(F.col("vec_id") % query_every == 0)
    n, asked, dim = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % query_every == 0), F.max("dim")).first()
    per = max(1, min(_PLACES // 4, tile_bytes // (8 * (dim or 1))))
    shards, groups = max(1, -(-n // per)), max(1, -(-asked // per))
    shard, group = F.pmod(F.xxhash64("rid"), F.lit(shards)), F.pmod(F.xxhash64(F.lit(1), "rid"), F.lit(groups))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = rows.select("rid", "vec_id", "v", "dim", shard.cast("int").alias("shard"), each(groups).alias("grp"))
    asks = queries.select(
        F.col("rid").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("q_dim"),
        group.cast("int").alias("q_grp"), each(shards).alias("shard"),
    )

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        return _tile(left, right, k)

    tiles = base.groupBy("shard", "grp", "dim").cogroup(asks.groupBy("shard", "q_grp", "q_dim"))
    lists = tiles.applyInArrow(tile, "query long, query_id long, shard int, ids array<long>, scores array<long>")
    # struct order: higher score first as ~score ascends without overflow, then smaller id
    top = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct(F.bitwise_not(x["scores"]).alias("down"), x["ids"].alias("vec_id")))
    lists = lists.select("query", "query_id", "shard", top.alias("top"))
    while True:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / F.lit(FAN_IN)).cast("int"))
        lists = lists.groupBy("query", "query_id", "shard").agg(F.collect_list("top").alias("tops"))
        lists = lists.select("query", "query_id", "shard", F.slice(F.sort_array(F.flatten("tops")), 1, k).alias("top"))
        shards = -(-shards // FAN_IN)
        if shards <= 1:
            break
    ranked = lists.select("query_id", F.posexplode("top").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not("hit.down").alias("score"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of all rows for every query row."""
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH r AS (
  SELECT ROW_NUMBER() OVER () AS row, vec_id, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row, vec_id, list_transform(e, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM r),
s AS (SELECT q.row AS query, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.row <> q.row AND len(q.e) = len(c.e)),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {K}
"""
