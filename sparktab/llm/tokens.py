"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern. The distinct pre-tokens of a slice of a batch become one ragged
array of symbols; in each round every sequence merges all occurrences of its own lowest-rank pair at once, left to right,
and sequences without a mergeable pair leave with the count of their symbols. A merge's own symbol only takes part in merges
of higher rank, so the rounds give what merging one pair at a time gives.

Defined results: null is an empty text with 0 bytes and 0 tokens; special strings in a text are one token each, as the
library takes them by default; rows that share a doc_id stay separate rows; an empty table gives an empty result; texts of
any length are read whole, a slice at a time; other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Characters cut at a time, and pre-tokens whose counts a Python worker keeps.
SLICE_CHARS, CACHE = 1_000_000, 400_000
LIMIT = 512
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks of merges as arrays; small and of fixed size, so it travels in the task's closure."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, model = spec["model"]["vocab"], spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without a normaliser is needed")
        self.prefix_space = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        self.pattern = pattern
        self.special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)
        self.start = np.zeros(256, np.int32)
        for symbol, byte in byte_symbols().items():
            self.start[byte] = ids[symbol]
        self.size = np.int64(max(ids.values()) + 1)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        codes = np.array([ids[a] * int(self.size) + ids[b] for a, b in merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        first = np.arange(256, dtype=np.int32)
        self.byte_ranks = self.rank(np.repeat(self.start[first], 256), np.tile(self.start[first], 256))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it doesn't merge."""
        codes = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.ranks[at], _NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each non-empty byte string."""
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        who = np.arange(len(words))
        ends = np.cumsum(lengths)
        symbols = self.start[raw]
        ranks = np.full(len(raw), _NONE, np.int32)
        ranks[:-1] = self.byte_ranks[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        ranks[ends - 1] = _NONE
        while len(who):
            low = np.minimum.reduceat(ranks, ends - lengths)
            live = low != _NONE
            if not live.all():
                out[who[~live]] = lengths[~live]
                keep = np.repeat(live, lengths)
                symbols, ranks, who, lengths, low = symbols[keep], ranks[keep], who[live], lengths[live], low[live]
                if not len(who):
                    break
            spread = np.repeat(low, lengths)
            hit = ranks == spread
            if (hit[1:] & hit[:-1]).any():  # a run of one symbol: pairs overlap, every other one merges
                at = np.arange(len(hit))
                begun = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, -1))
                hit &= (at - begun) % 2 == 0
            spots = np.flatnonzero(hit)
            symbols[spots] = self.made[spread[spots]]
            gone = np.zeros(len(hit), bool)
            gone[spots + 1] = True
            new = spots - np.searchsorted(spots + 1, spots, "right")
            lost = np.add.reduceat(gone, np.cumsum(lengths) - lengths, dtype=np.int64)
            symbols, ranks = symbols[~gone], ranks[~gone]
            lengths = lengths - lost
            ends = np.cumsum(lengths)
            edge = np.zeros(len(symbols) + 1, bool)
            edge[0] = edge[ends] = True  # edge[i]: i starts a sequence, or is one past the last
            for at in (new, new[~edge[new]] - 1):
                inner = ~edge[at + 1]
                ranks[at[~inner]] = _NONE
                at = at[inner]
                ranks[at] = self.rank(symbols[at], symbols[at + 1])
        return out


class Counter:
    """Counts tokens of texts; keeps the counts of up to CACHE pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.known = vocabulary, {}
        self.find = regex.compile(vocabulary.pattern).findall
        self.cut = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        segments = self.cut.split(text) if self.cut and any(s in text for s in self.vocabulary.special) else [text]
        words: list[str] = []
        for segment in segments:
            if segment and self.vocabulary.prefix_space and not segment[0].isspace():
                segment = " " + segment
            words += self.find(segment)
        return words, len(segments) - 1

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        held: list[tuple[list[str], int]] = []
        size = 0
        for text in texts:
            held.append(self.parts(text))
            size += len(text)
            if size >= SLICE_CHARS:
                out += self._counted(held)
                held, size = [], 0
        return out + self._counted(held)

    def _counted(self, held: list[tuple[list[str], int]]) -> list[int]:
        known = self.known
        new = [w for w in set().union(*(words for words, _ in held)) if w not in known]
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set().union(*(words for words, _ in held)))
            known.update(zip(new, self.vocabulary.count([w.encode() for w in new]).tolist(), strict=True))
        return [sum(map(known.__getitem__, words)) + special for words, special in held]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text)."""
    vocabulary = Vocabulary(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            counted = pa.array(counter.counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counted], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
