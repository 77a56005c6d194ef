"""Frequent phrases and their cohesion by Toivonen's sampling.

A random sample of the pieces of all documents is counted level by level (a phrase only if the phrases without its last and without its
first word are frequent there) under a lowered threshold; what is frequent there is proposed. One full pass then counts
exactly every phrase both of whose parts, without the last and without the first word, are proposed, and every single word:
the proposals and their negative border. If phrases of the border turn out frequent, they join the proposals and an expansion
pass counts the phrases that this admits, and those alone. There a phrase that is being counted for the first time counts as
proposed for longer ones, so all lengths close in that one pass: a frequent phrase's parts are frequent, and each is proposed,
found before, or counted in the pass itself. What is frequent is then known exactly, whatever the sample held.

Phrases are told apart by 96 bits, one 64-bit hash of their words and language and the upper half of another (two of a
billion phrases share them with a chance below 1e-11), as those bits are most of what is shuffled. The proposals reach the tasks as a bitmap of hash
bits, SPARE for each of them but no more than 2**BITS in all, so what is broadcast stays within 32 MB whatever the corpus; a bit
that several phrases share admits phrases to be counted that needn't be, and changes no result. Words of the frequent phrases are read from the sample again, and from the whole
table for the few that it lacks. Pieces are sampled, not documents, so that groups of copies and lines repeated within one
document are in the sample by their share.

Defined results: null is an empty text, which has no words; a null language is `und` and is one with documents marked so; equal
documents count each time; texts of any length count whole; words are split at the listed bytes alone, so words of other
scripts are kept; an empty table gives an empty result; doc_id and other columns are not looked at, rows that share one count
each.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialise, release
from .shingles import _LOWER, _OF_BYTE, _power, mix

#: Words of a phrase at most, occurrences that a candidate has, phrases of a language that are returned.
LONGEST, LEAST, TOP = 5, 100, 2000
#: One piece of SAMPLE is sampled; phrases are proposed from half of their expected share of LEAST on.
SAMPLE = 8
#: Binary logarithm of the largest bitmap's bits, bits for each proposal below that.
BITS, SPARE = 28, 64
#: Bytes of text that are looked at together; buckets of the first ranking.
SLICE_BYTES, BUCKETS = 1 << 20, 64
#: The bytes that end a piece, and those that end a word only.
_PIECE = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_BLANK = np.isin(np.arange(256), [0x20, 0x09])
_CUT = re.compile("[.,;:!?\\n-\\r]+")
_OTHER = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = mix(np.arange(1, LONGEST + 1, dtype=np.uint64)) | np.uint64(1)
#: Words longer than this get a cryptographic hash, as a polynomial modulo 2**64 is weak on long ones.
_LONG_WORD = 255


def _half(second: np.ndarray) -> pa.Array:
    """The upper halves of second hashes, as they are kept."""
    return pa.array((second.astype(np.uint64, copy=False) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _keys(s1: str, s2: str) -> list[Column]:
    """k1 and k2 of a language's seeds."""
    return [F.col(s1).alias("k1"), F.shiftright(s2, 32).cast("int").alias("k2")]


class Words:
    """The words of some texts: where they are, the piece and the text that each lies in, their two hashes."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray):
        self.raw = raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        hard = _PIECE[raw]
        turn = np.flatnonzero(np.diff(~(hard | _BLANK[raw]), prepend=False))
        self.starts, self.ends = turn[0::2], turn[1::2]
        self.piece = np.cumsum(hard)[self.starts] if len(turn) else self.starts
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, "right")
        up, down = _power(len(raw) + 1)
        lanes = []
        for table in (_OF_BYTE, _OTHER):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(table[raw] * up[:-1], out=sums[1:])
            lanes.append(mix((sums[self.ends] - sums[self.starts]) * down[self.starts]))
        for i in np.flatnonzero(self.ends - self.starts > _LONG_WORD).tolist():
            digest = hashlib.blake2b(raw[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            lanes[0][i], lanes[1][i] = np.frombuffer(digest, "<u8")
        self.hashes = [mix(lane + seeds[self.text, j]) for j, lane in enumerate(lanes)]

    def phrases(self, bits: list[np.ndarray | None], longest: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
        """For each length: where phrases begin that the last of the bitmaps admits, their keys, and whether the first of
        two bitmaps admits them as well. Of two bitmaps, what the first doesn't admit leads on to longer phrases whether the
        second holds it or not. Without a bitmap (None) nothing is admitted but words."""
        at = np.arange(len(self.starts))
        keys = self.hashes
        old = np.ones(len(at), bool) if len(bits) > 1 else np.zeros(len(at), bool)
        yield 1, at, keys, old
        for n in range(2, longest + 1):
            if bits[-1] is None:
                return
            member = _has(bits[-1], keys[0])
            if n > 2 and len(bits) > 1:
                member |= ~old
            before = _has(bits[0], keys[0]) & old if len(bits) > 1 else old
            # a phrase's first part starts with it, its second one word on
            pair = np.flatnonzero((at[1:] == at[:-1] + 1) & member[1:] & member[:-1])
            pair = pair[self.piece[at[pair]] == self.piece[at[pair] + n - 1]]
            both = before[pair] & before[pair + 1] if len(bits) > 1 else np.zeros(len(pair), bool)
            at, keys, old = at[pair], [mix(k[pair] + w[at[pair] + n - 1] * _ODD[n - 1]) for k, w in zip(keys, self.hashes, strict=True)], both
            yield n, at, keys, old


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    spot = key >> np.uint64(58 - (len(bits).bit_length() - 1))
    return (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) != 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, list]]:
    """texts, seeds and langs of rows whose texts make about SLICE_BYTES."""
    texts, seeds, langs, size = [], [], [], 0
    for batch in batches:
        lang = batch.column("lang") if "lang" in batch.schema.names else pa.nulls(batch.num_rows)
        for text, a, b, c in zip(batch.column("text"), batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), lang.to_pylist(), strict=True):
            texts.append((text.as_py() or "").encode())
            seeds.append((a, b))
            langs.append(c)
            size += len(texts[-1])
            if size >= SLICE_BYTES:
                yield texts, np.array(seeds, np.int64).view(np.uint64), langs
                texts, seeds, langs, size = [], [], [], 0
    if texts:
        yield texts, np.array(seeds, np.int64).view(np.uint64), langs


def _summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and how often each stands; one may come twice if its first half is another's too."""
    order = np.argsort(keys[0])
    a, b = keys[0][order], keys[1][order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order
    return a[new], b[new], np.diff(np.append(new, len(a)))


def _count(docs: DataFrame, bits: list, least: int, levels: tuple[int, int] = (1, LONGEST), totals: bool = False) -> DataFrame:
    """k1, k2 (of 32 bits), f of the phrases of these lengths that the last bitmap admits and the first of two doesn't, f >= least.

    With totals, (s1, s2) of each language stand with the number of its words as well, and once more with f = 0.
    """
    spark = docs.sparkSession
    sent = [None if b is None else spark.sparkContext.broadcast(b) for b in bits]
    kinds = docs.select(*_keys("s1", "s2"), F.lit(0).cast("long").alias("f")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [None if b is None else b.value for b in sent]
        for texts, seeds, _ in _slices(batches):
            words = Words(texts, seeds)
            for n, _, keys, old in words.phrases(own, levels[1]):
                if n >= levels[0]:
                    yield sent_rows(*_summed([k[~old] for k in keys]))
            pa.default_memory_pool().release_unused()
            if totals:
                kinds, which = np.unique(seeds, axis=0, return_inverse=True)
                yield sent_rows(kinds[:, 0], kinds[:, 1], np.bincount(which.ravel()[words.text], minlength=len(kinds)))

    def sent_rows(first: np.ndarray, second: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        first, f = (pa.array(c.astype(np.uint64, copy=False).view(np.int64)) for c in (first, f))
        return pa.RecordBatch.from_arrays([first, _half(second), f], ["k1", "k2", "f"])

    counted = docs.select("text", "s1", "s2").mapInArrow(run, "k1 long, k2 int, f long")
    counted = counted.groupBy("k1", "k2").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    out = materialise(counted.unionByName(kinds) if totals else counted)
    for b in filter(None, sent):
        b.destroy()
    return out


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The keys' hash bits; at most 2**(BITS - 6) rows reach the driver, whatever the corpus."""
    size = min(BITS, max(12, (keys.count() * SPARE).bit_length()))
    spot = F.shiftrightunsigned("k1", 64 - size)
    rows = keys.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(k1, {64 - size}) % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def piece_sample(docs: DataFrame) -> DataFrame:
    """docs with one piece of SAMPLE, drawn at random, in place of each text. No result depends on the draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            texts = []
            for text in batch.column("text"):
                pieces = _CUT.split(text.as_py() or "")
                texts.append("\n".join(pieces[i] for i in np.flatnonzero(draw.random(len(pieces)) * SAMPLE < 1).tolist()))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def frequent(docs: DataFrame, sample: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases(k1, k2, f), words(k1, k2, f)): all phrases of docs(text, s1, s2) with f >= least, and the number of words of each language under its seeds."""
    lowered = max(2, least // (2 * SAMPLE))
    levels: list[DataFrame] = []
    bits = None
    for n in range(1, longest + 1):
        levels.append(_count(sample, [bits], lowered, (n, n)))
        proposed = functools.reduce(DataFrame.unionByName, levels)
        bits = _bitmap(proposed)
    found = _count(docs, [bits], least, (1, longest), totals=True)
    seeds = found.where("f = 0").select("k1", "k2")
    words = materialise(found.where("f > 0").join(seeds, ["k1", "k2"], "left_semi"))
    rounds = [materialise(found.where("f > 0").join(seeds, ["k1", "k2"], "left_anti"))]
    failed = materialise(rounds[0].join(proposed, ["k1", "k2"], "left_anti"))
    if failed.count():
        rounds.append(_count(docs, [bits, _bitmap(proposed.unionByName(failed))], least, (2, longest)))
    phrases = materialise(functools.reduce(DataFrame.unionByName, rounds))
    release(found, *levels, *rounds)
    return phrases, words


def _spelled(docs: DataFrame, phrases: DataFrame, keys: DataFrame, longest: int) -> DataFrame:
    """k1, k2, lang, phrase of those of these keys of frequent phrases that occur in docs."""
    # frequent phrases' parts are frequent, so the bits of all lead to each of them
    context = docs.sparkSession.sparkContext
    sent, asked = context.broadcast(_bitmap(phrases)), context.broadcast(_bitmap(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, wanted = sent.value, asked.value
        for texts, seeds, langs in _slices(batches):
            words = Words(texts, seeds)
            out: dict[tuple[int, int], tuple[str, str]] = {}
            for n, at, key, _ in words.phrases([bits], longest):
                keep = np.flatnonzero(_has(wanted, key[0]))
                _, first = np.unique(key[0][keep], return_index=True)
                for i in keep[first].tolist():
                    own = range(at[i], at[i] + n)
                    phrase = b" ".join(words.raw[words.starts[j] : words.ends[j]].tobytes() for j in own)
                    out[int(key[0][i]), int(key[1][i])] = (langs[words.text[at[i]]], phrase.decode())
            keys = np.array(list(out), np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].view(np.int64)), _half(keys[:, 1]), *[pa.array([v[j] for v in out.values()], pa.string()) for j in (0, 1)]], ["k1", "k2", "lang", "phrase"])

    spelled = docs.select("text", "s1", "s2", "lang").mapInArrow(run, "k1 long, k2 int, lang string, phrase string").join(keys.select("k1", "k2"), ["k1", "k2"], "left_semi")
    out = materialise(spelled.groupBy("k1", "k2").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase")))
    sent.destroy()
    asked.destroy()
    return out


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of every phrase of 1 to longest words with f >= least in its language, and (lang, n) words of each language with so many."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang"), F.xxhash64(F.lit(1), lang).alias("s1"), F.xxhash64(F.lit(2), lang).alias("s2"))
    sample = materialise(piece_sample(rows))
    phrases, words = frequent(rows, sample, longest, least)
    known = _spelled(sample, phrases, phrases, longest)
    rest = materialise(phrases.join(known, ["k1", "k2"], "left_anti"))
    if rest.count():
        known = known.unionByName(_spelled(rows, phrases, rest, longest))
    release(sample)
    langs = rows.select("lang", *_keys("s1", "s2")).distinct()
    return phrases.join(known, ["k1", "k2"]).select("lang", "phrase", "f"), words.join(langs, ["k1", "k2"]).select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs(text, lang): each language's first phrases by score."""
    counts, words = phrase_counts(docs, longest, least)
    counts = materialise(counts.withColumn("w", F.split("phrase", " ")))
    several = counts.where(F.size("w") > 1)
    part = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    # phrases within longer ones of the same count
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: part(i, n))))
    within = several.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = several.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < 100 * F.col("f"), F.lit(True)))
    cuts = kept.select("lang", "phrase", "f", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("x"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("y"))
    side = lambda p, c: counts.select("lang", F.col("phrase").alias(p), F.col("f").alias(c))
    cuts = cuts.join(side("x", "l"), ["lang", "x"]).join(side("y", "r"), ["lang", "y"]).join(words, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # products of up to 38 digits, divided exactly
    scored = cuts.withColumns({"_up": (wide("f") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "_down": (wide("l") * wide("r")).cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.first("f").alias("a"), F.first("n").alias("n"))
    flat = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # buckets first, so no task ranks all phrases of one language
    flat = flat.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    flat = flat.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("_place") <= top)
    ranked = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best phrases over all documents."""
    return collocations(documents(spark, sf_dir, "text", "lang"))


ORACLE = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, UNNEST(regexp_split_to_array(
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, UNNEST(range(1, len(w) - k + 2)) AS i FROM w, (SELECT UNNEST(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, COUNT(*) AS f FROM g GROUP BY ALL HAVING COUNT(*) >= 100),
n AS (SELECT lang, SUM(len(w))::HUGEINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, MAX(a) AS longer
  FROM (SELECT *, UNNEST(range(1, k - j + 2)) AS i FROM c, (SELECT UNNEST(range(2, 5)) AS j) WHERE j < k) GROUP BY ALL),
x AS (SELECT c.*, UNNEST(range(1, c.k)) AS cut FROM c LEFT JOIN s USING (lang, phrase) WHERE s.longer IS NULL OR 100 * s.longer < 100 * c.a),
y AS (SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * x.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[:x.cut], ' ')
    JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ') JOIN n ON n.lang = x.lang),
z AS (SELECT * FROM y QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z QUALIFY rank <= 2000
"""
