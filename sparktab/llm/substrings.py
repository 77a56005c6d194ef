"""Exact substring deduplication with suffix arrays.

Every byte is removed that a LENGTH-byte string covers which also starts in a document of smaller doc_id; strings are judged
on the input and don't cross documents. Documents are dealt to shards by a hash of doc_id.

1. In each shard, each LENGTH-byte window picks its anchor, the least hash of its GRAM-byte grams (the first of equals), so
   equal windows have equal anchors at equal places. The shard sends its sorted distinct anchor hashes.
2. The sorted lists of all shards, cut into ranges of hashes by binary search, are merged; anchors of one document go.
3. Each shard finds its windows with a remaining anchor and sends them, neighbours of one anchor as one piece of text, each
   distinct piece once. Pieces of consecutive content shards travel as one parcel.
4. Pieces meet in content shards by anchor, which a parcel's task takes one after the other. A content shard sorts the suffixes of its distinct pieces (suffixes.py), takes
   common prefixes, and so finds the runs of equal windows and each run's smallest doc_id; windows above it are removed.
5. Each shard cuts its documents.

All copies of a window meet in one content shard, and a shard sends a repeated piece once, so hot passages cost a row per
shard. The windows of an anchor that more than HOT_SHARDS shards hold travel one by one, by a hash of their own bytes.
The documents are shuffled once; the three passes over them read the same exchange.

Defined results: null is an empty text; a row without doc_id keeps its bytes and is no other's source; rows that share a
doc_id stay separate rows and are no sources of each other; an empty table gives an empty result; other columns are not
looked at; long texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shards_for, text_hash
from .shingles import mix
from .suffixes import common_prefixes, packed, suffix_array

LENGTH, GRAM = 50, 24
#: Estimated input bytes of a shard, and bytes of text whose anchors are sought at a time.
SHARD_BYTES, SLICE = 4_000_000, 300_000
#: Content shards for each shard; their suffix arrays take about a hundred bytes a byte of text.
BUCKETS = 8
#: What a shard sends goes to PARCELS tasks or, with more shards, to one for every SHARDS_A_PARCEL of them, so that a shard's
#: parcels don't become as many, and as small, as there are shards.
PARCELS, SHARDS_A_PARCEL = 1024, 4
HOT_SHARDS = 1024
_SPAN = LENGTH - GRAM + 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PLACE = np.uint64((1 << 24) - 1)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first window, last window) for each run of windows with one anchor; windows by their start in the text."""
    none = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    eight = packed(raw, 0) if len(raw) < LENGTH else packed(raw, 8)
    grams = eight[: n + _SPAN - 1] * _ODD[0]
    grams += mix(eight[8 : n + _SPAN + 7]) * _ODD[1]
    grams ^= eight[16 : n + _SPAN + 15] * _ODD[2]
    grams = mix(grams)
    if len(grams) >= 1 << 24:  # places beyond 24 bits: a long text, in overlapping parts
        return _anchors_of_long(texts)
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: n], low[_SPAN - 16 : n + _SPAN - 16])
    owner = (low & _PLACE).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    inside = np.arange(n) + LENGTH <= ends[text]
    owner[~inside] = -1
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    keep = owner[first] >= 0
    first, last = first[keep], last[keep]
    # the same anchor may be owned on both sides of a border between texts
    begin = (ends - sizes)[text[first]]
    return grams[owner[first]], text[first], first - begin, last - begin


def _anchors_of_long(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found: list[tuple] = []
    step = 1 << 23
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), step):
            h, _, first, last = anchors([text[at : at + step + LENGTH - 1]])
            found.append((h, np.full(len(h), i), first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _sliced(texts: list[bytes]):
    """(index of the first, texts) for runs of about SLICE bytes."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= SLICE:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _in_order(table: pa.Table) -> pa.Table:
    """The rows of a shard in an order that every pass over it has."""
    return table.sort_by([("doc_id", "ascending"), ("text_key", "ascending")])


def _texts(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").to_pylist()]


def _by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range of keys that each lies in; ascends with the key."""
    return ((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _keys(hashes: np.ndarray) -> np.ndarray:
    """The upper 48 bits, enough to pair anchors: a chance pair costs a comparison, no wrong removal."""
    return hashes >> np.uint64(16)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed differences, bytes of one weight together; random or sorted, it halves the shuffle."""
    steps = np.diff(numbers.astype(np.int64), prepend=np.int64(0))
    return _squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(packet: bytes) -> np.ndarray:
    raw = np.frombuffer(_unsqueeze(packet), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel())


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8) + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(packet: bytes) -> bytes:
    return pa.decompress(packet[8:], decompressed_size=int.from_bytes(packet[:8]), codec="zstd", asbytes=True)


def _packets(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of an ascending array."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return starts, np.concatenate([starts[1:], [len(bucket)]]) if len(starts) else starts


def _offers(key: tuple[pa.Scalar, ...], table: pa.Table, buckets: int) -> pa.Table:
    """Step 1: (bucket, shard, hashes): a shard's distinct anchors; the lowest bit says whether two documents hold it."""
    table = _in_order(table)
    texts, ids = _texts(table), table.column("doc_id").fill_null(-(2**63)).to_numpy()
    sound = table.column("doc_id").is_valid().to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at, held in _sliced(texts):
        h, text, _, _ = anchors(held)
        keep = sound[at + text]
        found.append((h[keep], ids[at + text[keep]]))
    h = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
    doc = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    h = _keys(h)
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    starts, _ = _packets(h)
    if len(starts):
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        h = h[starts] << np.uint64(1) | several.astype(np.uint64)
    bucket = _by_bucket(h >> np.uint64(1), buckets)
    starts, ends = _packets(bucket)
    return pa.table({"bucket": pa.array(bucket[starts], pa.int32()), "shard": pa.array(np.full(len(starts), key[0].as_py()), pa.int32()), "hashes": pa.array([_pack(h[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())})


def _merged(table: pa.Table) -> pa.Table:
    """Step 2: (shard, hashes): of each shard's anchors those that another document holds; the lowest bit says: in many shards."""
    lists = [_unpack(x) for x in table.column("hashes").to_pylist()]
    every = np.sort(np.concatenate(lists))
    plain = every >> 1
    starts, ends = _packets(plain)
    count = ends - starts
    shared = (count > 1) | (np.maximum.reduceat(every & 1, starts) > 0)
    known = plain[starts][shared]
    hot = (count[shared] > HOT_SHARDS).astype(np.int64)
    out = []
    for own in lists:
        own = own >> 1
        at = np.searchsorted(known, own)  # binary search of the shard's list in the merged one
        hit = (at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == own) if len(known) else np.zeros(len(own), bool)
        out.append(_pack(own[hit] << 1 | hot[at[hit]]) if hit.any() else b"")
    return pa.table({"shard": table.column("shard"), "hashes": pa.array(out, pa.binary())}).filter(pa.array([bool(x) for x in out], pa.bool_()))


def parcels(shards: int) -> int:
    """Tasks that what the shards send is dealt to, at most as many as content shards."""
    return min(BUCKETS * shards, max(PARCELS, -(-shards // SHARDS_A_PARCEL)))


_PIECES = "parcel int, shard int, text binary, sizes binary, holders binary"


def _pieces(key: tuple[pa.Scalar, ...], docs: pa.Table, shared: pa.Table, buckets: int, each: int) -> pa.Table:
    """Step 3: (parcel, shard, text, sizes, holders): distinct pieces of the shard in the order of their content shards, each of
    which make a parcel; sizes, then content shards; (piece, doc_id, row, start) of each holder."""
    docs = _in_order(docs)
    known = np.sort(np.concatenate([np.zeros(0, np.int64), *map(_unpack, shared.column("hashes").to_pylist())])).astype(np.uint64)
    plain = known >> np.uint64(1)
    texts, ids = _texts(docs), docs.column("doc_id").fill_null(-(2**63)).to_numpy()
    sound = docs.column("doc_id").is_valid().to_numpy()
    seen: dict[bytes, int] = {}
    where: list[int] = []
    holders: list[tuple[int, int, int, int]] = []
    for at, held in _sliced(texts) if len(known) else ():
        h, text, first, last = anchors(held)
        h = _keys(h)
        spot = np.minimum(np.searchsorted(plain, h), len(plain) - 1)
        hit = (plain[spot] == h) & sound[at + text]
        spot, h, text, first, last = spot[hit], h[hit], text[hit], first[hit], last[hit]
        bucket = _by_bucket(h, buckets)
        for hot, b, t, p, q in zip((known[spot] & np.uint64(1)).tolist(), bucket.tolist(), text.tolist(), first.tolist(), last.tolist(), strict=True):
            for i, j in ((p, q),) if not hot else ((x, x) for x in range(p, q + 1)):
                piece = held[t][i : j + LENGTH]
                number = seen.setdefault(piece, len(where))
                if number == len(where):
                    where.append(b if not hot else int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest()) * buckets >> 64)
                holders.append((number, int(ids[at + t]), at + t, i))
    if not where:
        return pa.table({"parcel": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "text": pa.array([], pa.binary()), "sizes": pa.array([], pa.binary()), "holders": pa.array([], pa.binary())})
    texts_, own = list(seen), np.array(where)
    sizes = np.array([len(x) for x in texts_], np.int32)
    order = np.argsort(own, kind="stable")
    place = np.empty(len(own), np.int64)
    held_ = np.array(holders, np.int64)
    held_ = held_[np.argsort(own[held_[:, 0]], kind="stable")]
    starts, ends = _packets(own[order] // each)
    numbers = own[order][starts] // each
    cuts = np.searchsorted(own[held_[:, 0]] // each, numbers, "left"), np.searchsorted(own[held_[:, 0]] // each, numbers, "right")
    rows = []
    for a, b, c, d in zip(starts, ends, *cuts, strict=True):
        some = order[a:b]
        place[some] = np.arange(len(some))
        part = held_[c:d].copy()
        part[:, 0] = place[part[:, 0]]
        rows.append((int(own[some[0]]) // each, key[0].as_py(), _squeeze(b"".join(texts_[i] for i in some)), _pack(np.concatenate([sizes[some], own[some]])), _pack(part.T.ravel())))
    return pa.table({n: pa.array(c, k) for (n, k), c in zip((("parcel", pa.int32()), ("shard", pa.int32()), ("text", pa.binary()), ("sizes", pa.binary()), ("holders", pa.binary())), zip(*rows, strict=True), strict=True)})


def repeated(pieces: list[bytes], least: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For pieces and the smallest doc_id of each: the number of each distinct piece, and by number the smallest doc_id of every
    window."""
    numbers: dict[bytes, int] = {}
    which, smallest = np.empty(len(pieces), np.int64), []
    for i, (piece, doc) in enumerate(zip(pieces, least, strict=True)):
        which[i] = number = numbers.setdefault(piece, len(smallest))
        if number == len(smallest):
            smallest.append(doc)
        elif doc < smallest[number]:
            smallest[number] = doc
    size = np.array([len(p) for p in numbers], np.int64)
    raw = np.frombuffer(b"".join(numbers), np.uint8)
    begin = np.cumsum(size) - size
    words = packed(raw)
    order = suffix_array(words, len(raw))
    run = np.cumsum(common_prefixes(words, order, LENGTH) < LENGTH) - 1
    owner = np.repeat(np.arange(len(size)), size)
    window = np.arange(len(raw)) - begin[owner] + LENGTH <= size[owner]
    doc = np.where(window, np.array(smallest, np.int64)[owner], 2**63 - 1)
    low = np.full(run[-1] + 1, 2**63 - 1, np.int64)
    np.minimum.at(low, run, doc[order])
    of_place = np.empty(len(raw), np.int64)
    of_place[order] = low[run]
    return which, [of_place[b : b + n - LENGTH + 1] for b, n in zip(begin.tolist(), size.tolist(), strict=True)]


def _removals(table: pa.Table) -> pa.Table:
    """Step 4: (shard, spans): (row, start, end) of bytes to remove, as the windows of a parcel's content shards tell."""
    text = b"".join(map(_unsqueeze, table.column("text").to_pylist()))
    lists = [_unpack(x).reshape(2, -1) for x in table.column("sizes").to_pylist()]
    held = [np.ascontiguousarray(_unpack(x).reshape(4, -1).T) for x in table.column("holders").to_pylist()]
    counts = np.array([x.shape[1] for x in lists], np.int64)
    for x, before in zip(held, (np.cumsum(counts) - counts).tolist(), strict=True):
        x[:, 0] += before
    sender = np.repeat(np.arange(len(held)), [len(x) for x in held])
    shards = table.column("shard").to_numpy()
    del table
    sizes, bucket = np.concatenate(lists, 1)
    holders = np.concatenate(held)
    del lists, held
    ends = np.cumsum(sizes)
    least = np.full(len(sizes), 2**63 - 1, np.int64)
    np.minimum.at(least, holders[:, 0], holders[:, 1])
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by = np.argsort(bucket[holders[:, 0]], kind="stable")
    holders, sender = holders[by], sender[by]
    begun, over = _packets(bucket[order])
    numbers = bucket[order][begun]
    cuts = (np.searchsorted(bucket[holders[:, 0]], numbers, side) for side in ("left", "right"))
    out = [np.zeros((0, 4), np.int64)]
    for a, b, c, d in zip(begun.tolist(), over.tolist(), *cuts, strict=True):
        some, mine = order[a:b], holders[c:d]
        pieces = [text[x - n : x] for x, n in zip(ends[some].tolist(), sizes[some].tolist(), strict=True)]
        which, lows = repeated(pieces, least[some].tolist())
        windows = np.array([len(x) for x in lows], np.int64)
        begin = np.cumsum(windows) - windows
        piece = which[place[mine[:, 0]] - a]
        n = windows[piece]
        each = np.repeat(np.arange(len(mine)), n)
        offset = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        gone = np.concatenate(lows)[np.repeat(begin[piece], n) + offset] < mine[each, 1]
        each, offset = each[gone], offset[gone]
        row, start = mine[each, 2], mine[each, 3] + offset
        first, last = _packets(each * (1 << 40) + offset - np.arange(len(each)))  # steps of one within a holder
        out.append(np.stack([sender[c:d][each[first]], row[first], start[first], start[last - 1] + LENGTH], 1))
    spans = np.concatenate(out)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    first, last = _packets(spans[:, 0])
    return pa.table({"shard": pa.array(shards[spans[first, 0]], pa.int32()), "spans": pa.array([_pack(np.ascontiguousarray(spans[a:b, 1:].T).ravel()) for a, b in zip(first, last, strict=True)], pa.binary())})


def _union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    upto = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > upto[:-1]]))
    return np.stack([spans[first, 0], upto[np.concatenate([first[1:], [len(spans)]]) - 1]], 1)


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Step 5: a shard's documents with what is left of them."""
    docs = _in_order(docs)
    texts = _texts(docs)
    every = np.concatenate([np.zeros((0, 3), np.int64), *(_unpack(x).reshape(3, -1).T for x in spans.column("spans").to_pylist())])
    every = every[np.argsort(every[:, 0], kind="stable")]
    ends = np.searchsorted(every[:, 0], np.arange(len(texts)), "right")
    begins = np.concatenate([[0], ends[:-1]])
    removed, runs, kept = [], [], []
    for text, a, b in zip(texts, begins.tolist(), ends.tolist(), strict=True):
        if a == b:
            removed.append(0)
            runs.append([])
            kept.append(text)
            continue
        union = _union(every[a:b, 1:])
        removed.append(int((union[:, 1] - union[:, 0]).sum()))
        runs.append(union.ravel().tolist())
        edges = [0, *union.ravel().tolist(), len(text)]
        kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
    return pa.table(
        {
            "doc_id": docs.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array([len(r) // 2 for r in runs], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()), "spans": pa.array(runs, pa.list_(pa.int64())),
        }
    )


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends of removed runs) per row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_hash(F.col("text")).alias("text_key"))
    shards = shards_for(docs, shard_bytes)
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).cast("int"))

    buckets, sent = BUCKETS * shards, parcels(shards)

    def offers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _offers(key, table, sent)

    def pieces(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return _pieces(key, left, right, buckets, -(-buckets // sent))

    offered = dealt.groupBy("shard").applyInArrow(offers, "bucket int, shard int, hashes binary")
    shared = offered.groupBy("bucket").applyInArrow(_merged, "shard int, hashes binary")
    found = dealt.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(pieces, _PIECES)
    gone = found.groupBy("parcel").applyInArrow(_removals, "shard int, spans binary")
    return dealt.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text")).drop("spans")
