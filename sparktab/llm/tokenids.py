"""Token ids of all documents as entropy-coded files: a static range asymmetric numeral system.

Documents are dealt into shards by ranges of doc_id and encoded in order, so the ids of one shard are consecutive. They are
cut into blocks of BLOCK ids. One table of frequencies of all ids of the corpus, scaled to a power of two, serves every
block; a block is coded on its own by LANES interleaved coders whose 32-bit words share one stream. A block keeps the lanes'
states at every MARK steps with the place in its words (its checkpoints), so its parts are decoded side by side, the CRC-32
of its ids, and which documents lie in it. Readers fail on a block or table whose checksum differs.

Files under the folder: `frequencies` (id, freq), `shards` (shard, first, n_ids), `blocks` in ascending order of documents.
All are Parquet written by Spark: a lost executor's part is written again before anything is committed, and any store works.

Ids come from the tokenizers library. For byte-level vocabularies without a normaliser texts are cut, as arrays of bytes, where
the vocabulary's pattern always cuts, the distinct pieces of a slice are cut by the pattern where they aren't one pre-token, and
the library's model encodes distinct pre-tokens, many a call; a worker keeps the ids of pieces. Texts that hold an added token's
string, and all texts where no pattern is given or the vocabulary is of another kind, go through the library whole.

Defined results: null is an empty text and has the end id alone; special strings in a text are taken as the library takes
them by default; rows without doc_id come first, rows that share one are ordered by a hash of their texts, and rows equal in
both are interchangeable; a document of any length spans as many blocks as it needs; an empty table gives empty files and an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, input_bytes, materialise, release, shared_dir
from .tokens import byte_symbols

#: Ids of a block, coders of a block, steps from one checkpoint to the next.
BLOCK, LANES, MARK = 1 << 15, 32, 256
#: Blocks coded side by side, estimated bytes of text of a shard.
TOGETHER, SHARD_BYTES = 64, 64 << 20
#: Bytes of text that are cut at a time, pieces met lately whose ids a worker keeps (and as many met before), words of a call.
SLICE_BYTES, CACHE, CALL = 8 << 20, 500_000, 256
#: Estimated bytes of raw blocks whose counts one task adds up.
COUNT_BYTES = 256 << 20
#: Bytes of the longest piece whose ids are kept.
LONG_PIECE = 64
END_ID = 2
_LOW, _WORD, _HALF = np.uint64(1 << 31), np.uint64(32), np.uint64(0xFFFFFFFF)
#: Classes of bytes: unknown, letter, digit, other sign, apostrophe, lead byte of what is no white space, space, other white space.
_ANY, _LETTER, _DIGIT, _SIGN, _QUOTE, _BEYOND, _SPACE, _BLANK = range(8)


def _class(byte: int) -> int:
    if byte >= 0x80:
        # 0xC3 to 0xC5 begin Latin letters; 0xC2 and 0xE1 to 0xE3 may begin white space
        return _LETTER if 0xC3 <= byte <= 0xC5 else _BEYOND if byte > 0xC5 and not 0xE1 <= byte <= 0xE3 else _ANY
    if 0x1C <= byte <= 0x1F:
        return _ANY
    c = chr(byte)
    return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c == " " else _BLANK if c.isspace() else _QUOTE if c == "'" else _SIGN


_CLASSES = bytes(map(_class, range(256)))
#: Whether a pre-token always ends between bytes of two classes, the first one times 8.
_ENDS = bytearray(256)
for _a, _others in ((_LETTER, (_DIGIT, _SIGN, _QUOTE)), (_DIGIT, (_LETTER, _SIGN, _QUOTE)), (_SIGN, (_LETTER, _DIGIT)), (_QUOTE, (_DIGIT,))):
    for _b in (*_others, _SPACE, _BLANK):
        _ENDS[_a << 3 | _b] = 1


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8; both bytes of a Latin letter count as letters."""
    kind = np.frombuffer(bytearray(data.tobytes().translate(_CLASSES)), np.uint8)
    lead = np.flatnonzero(data[:-1] - np.uint8(0xC3) < 3)
    kind[lead + 1] = _LETTER
    odd = lead[(data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))]  # times and divided by
    kind[odd] = kind[odd + 1] = _ANY
    return kind


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each byte of texts in UTF-8 that lie between bounds, and one more for the end.

    Pieces have the same pre-tokens on their own as within their text: each cut is one that byte-level vocabularies' pattern
    makes, and before a cut white space is at most one character, or is followed by a space and another character.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    if len(data) < 2:
        return cut
    kind = _kinds(data)
    ends = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(bytes(_ENDS)), bool)
    shown = kind - np.uint8(1) < 5  # no white space for certain
    clear = kind - np.uint8(1) < 4  # that, and a whole character
    cut[1:-1] |= ends
    cut[1:-2] |= (kind[1:-1] == _SPACE) & shown[2:]
    cut[2:-1] |= (kind[1:-1] == _BLANK) & clear[:-2] & clear[2:]
    # what looked beyond a text's edge is undone: a space at its end, a piece after its first character
    begin, end = bounds[:-1][np.diff(bounds) > 1], bounds[1:][np.diff(bounds) > 1]
    for at in (begin + 1, end - 1):
        cut[at] = ends[at - 1]
    return cut


class Ids:
    """Ids of texts as bytes of little-endian numbers, one of these in each Python worker."""

    def __init__(self, path: str, pattern: str | None, dtype: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain = plain and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        self.cuts = bool(pattern) and plain and all(c in model["vocab"] for c in byte_symbols())
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = dtype
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        if self.cuts:
            self.find = regex.compile(pattern).findall
            # the same model, given pre-tokens by the line
            lines = {"version": spec.get("version"), "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "model": model}
            self.by_line = Tokenizer.from_str(json.dumps(lines))
            self.by_line.model._resize_cache(0)  # each word comes once, so its own cache would only be filled
            self.printable = np.zeros(256, "<u2")
            for symbol, byte in byte_symbols().items():
                self.printable[byte] = ord(symbol)
            self.lengths = np.zeros(max(model["vocab"].values()) + 1, np.int64)
            for token, at in model["vocab"].items():
                self.lengths[at] = len(token)

    def encode(self, text: str) -> bytes:
        return b"".join(bytes(ids) for ids, _ in self.encode_all(pa.array([text]), b""))

    def encode_all(self, texts: pa.Array, ending: bytes) -> Iterator[tuple[memoryview, np.ndarray]]:
        """Ids of slices of texts(string), ending after each text's, and how many bytes of them each text has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.full(len(texts), not self.cuts)
        for s in self.special if self.cuts else ():
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, "right")) - 1)
            yield self._slice(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], whole[at:to], ending)
            at = to

    def _slice(self, data: np.ndarray, bounds: np.ndarray, whole: np.ndarray, ending: bytes) -> tuple[memoryview, np.ndarray]:
        """Ids of texts that lie between bounds of data, and how many bytes of them each text has."""
        others = []
        if whole.any():
            spans = list(zip(bounds.tolist(), bounds[1:].tolist(), strict=False))
            for at in np.flatnonzero(whole):
                ids = self.library.encode_batch_fast([data[slice(*spans[at])].tobytes().decode()], add_special_tokens=False)[0].ids
                others.append(np.array(ids, self.dtype).tobytes())
            data = np.concatenate([np.zeros(0, np.uint8), *(data[a:b] for (a, b), w in zip(spans, whole, strict=True) if not w)])
            bounds = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(bounds)))])
        at = np.flatnonzero(cuts(data, bounds))
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        values = self._values(*_parts(coded.dictionary))
        # after the pieces of a text come the ids of a text that went through the library whole, and the ending
        after = np.searchsorted(at, bounds[1:])
        more = 1 + whole.astype(np.int64)
        put = np.full(int(more.sum()), len(values), np.int32)
        put[(np.cumsum(more) - 2)[whole]] = len(values) + 1 + np.arange(len(others))
        codes = np.insert(coded.indices.to_numpy(), np.repeat(after, more), put)
        ids = pa.array([*values, ending, *others], pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[after + np.cumsum(more)]
        return memoryview(ids.buffers()[2] or b"")[: ends[-1]], np.diff(ends, prepend=0)

    def _values(self, keys: list[bytes], lettered: np.ndarray) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        if older:
            for at, ids in zip(missing, map(older.get, [keys[i] for i in missing]), strict=True):
                if ids is not None:
                    out[at] = known[keys[at]] = ids
            missing = [i for i in missing if out[i] is None]
        new = np.array(missing, np.int64)
        words, cut = new[lettered[new]].tolist(), []
        for at in new[~lettered[new]].tolist():
            text = keys[at].decode()
            if text.removeprefix(" ").isalpha():
                words.append(at)
            else:
                cut.append((at, [w.encode() for w in self.find(text)]))
        self._keep([keys[at] for at in words], out, words)
        if cut:
            parts = [w for w in set().union(*(p for _, p in cut)) if w not in known]
            found: list[bytes | None] = [None] * len(parts)
            self._keep(parts, found, range(len(parts)))
            new = dict(zip(parts, found, strict=True))
            for at, pre in cut:
                out[at] = ids = b"".join([known[w] if w in known else new[w] for w in pre])
                if len(keys[at]) <= LONG_PIECE:
                    known[keys[at]] = ids
        return out

    def _keep(self, words: list[bytes], out: list[bytes | None], places: Sequence[int]) -> None:
        """Encode pre-tokens by the library's model, many a call, and put their ids at places of out."""
        known = self.known
        for at in range(0, len(words), CALL):
            some = words[at : at + CALL]
            sizes = list(map(len, some))
            lines = self.printable[np.frombuffer(b"\n".join(some), np.uint8)]
            lines[np.cumsum(sizes[:-1], dtype=np.int64) + np.arange(len(some) - 1)] = 10  # those between words, not those within
            ids = np.array(self.by_line.encode_batch_fast([lines.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(sizes)
            met = np.cumsum(self.lengths[ids])
            to = np.searchsorted(met, ends) + 1
            if not np.array_equal(met[to - 1], ends):
                raise ValueError("tokens don't add up to their words")
            data, width = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            to = (to * width).tolist()
            own = [data[a:b] for a, b in zip([0, *to], to, strict=False)]
            for place, value in zip(places[at : at + CALL], own, strict=True):
                out[place] = value
            known.update(zip(some, own, strict=True) if max(sizes) <= LONG_PIECE else [(w, v) for w, v in zip(some, own, strict=True) if len(w) <= LONG_PIECE])


def _parts(values: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Non-empty values of an array of binary as bytes, and whether each is letters alone, but for a space before them."""
    if not len(values):
        return [], np.zeros(0, bool)
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1]
    raw, data, first = np.frombuffer(data, np.uint8), data.to_pybytes(), ends[:-1]
    letters = _kinds(raw) == _LETTER
    letters[first[(raw[first] == 32) & (np.diff(ends) > 1)]] = True
    ends = ends.tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], np.logical_and.reduceat(letters[: ends[-1]], first)


@functools.lru_cache(maxsize=1)
def _kept(path: str, pattern: str | None, dtype: str) -> Ids:
    """One for all tasks of a Python worker."""
    return Ids(path, pattern, dtype)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to a power of two, at least 1 for each id that occurs."""
    bits = max(16, int(len(counts)).bit_length() + 4)
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    share = np.array([int(c) * (1 << bits) // total for c in counts.tolist()], np.int64)
    freq = np.where(counts > 0, np.maximum(share, 1), 0)
    spare = (1 << bits) - int(freq.sum())
    while spare:
        at = int(freq.argmax())
        step = spare if spare > 0 else max(spare, -(int(freq[at]) // 2))
        freq[at] += step
        spare -= step
    return freq


class Table:
    """The shared frequencies as arrays: as large as the vocabulary, whatever the corpus."""

    def __init__(self, freq: np.ndarray, mark: int | None = None):
        self.mark = mark or MARK
        self.bits = np.uint64(max(int(freq.sum()), 1).bit_length() - 1)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.part = (1 - 2.0**-51) / np.maximum(self.freq, 1)
        self.room = np.uint64(63) - self.bits
        # both in one number, as looking things up is what a step costs
        self.both = self.freq << _WORD | self.start
        self.crc = zlib.crc32(freq.astype("<i8").tobytes())
        self.filler = int(freq.argmax()) if len(freq) else 0

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray) -> list[tuple[bytes, bytes, list[int]]]:
        """For each row of ids(blocks, steps, lanes): words, the states at its checkpoints, and the words before each."""
        n, steps, lanes = ids.shape
        ids = np.ascontiguousarray(ids.transpose(1, 0, 2))
        state = np.full((n, lanes), _LOW, np.uint64)
        words, sent = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
        marks = []
        for at in range(steps - 1, -1, -1):
            now = ids[at]
            both = np.take(self.both, now)
            freq = both >> _WORD
            full = np.greater_equal(state, freq << self.room, out=sent[at])
            words[at] = state  # the low half
            state >>= full.astype(np.uint64) << np.uint64(5)
            # the quotient is below 2**43, so this one is exact or one too low
            above = (state * np.take(self.part, now)).astype(np.uint64)
            rest = state - above * freq
            low = rest >= freq
            above += low
            rest -= freq * low
            both &= _HALF
            state = (above << self.bits) + rest + both
            if at % self.mark == 0:
                marks.append(state.copy())
        marks = np.stack(marks[::-1], 1)
        counts = sent.sum(2).cumsum(0)
        places = np.concatenate([np.zeros((1, n), np.int64), counts[self.mark - 1 : steps - 1 : self.mark]]).T
        return [(words[:, b][sent[:, b]].astype("<u4").tobytes(), marks[b].astype("<u8").tobytes(), places[b].tolist()) for b in range(n)]

    def decode(self, slots: np.ndarray, words: np.ndarray, states: np.ndarray, places: np.ndarray, steps: int) -> np.ndarray:
        """ids(parts, steps, lanes) of parts that begin at these places of words with these states(parts, lanes)."""
        out = np.empty((steps, *states.shape), np.int32)
        state, place, mask = states.copy(), places[:, None].astype(np.int64) - 1, np.uint64((1 << int(self.bits)) - 1)
        words = np.append(words, np.uint32(0)).astype(np.uint64)
        for at in range(steps):
            slot = state & mask
            now = np.take(slots, slot.view(np.int64), out=out[at])
            both = np.take(self.both, now)
            state >>= self.bits
            state *= both >> _WORD
            state += slot
            state -= both & _HALF
            short = state < _LOW
            taken = np.cumsum(short, 1)
            taken += place
            place = taken[:, -1:].copy()
            more = np.take(words, taken, mode="clip")
            state = np.where(short, (state << _WORD) | more, state)
        return out.transpose(1, 0, 2)


def crc_of_both(a: int, b: int, n: int) -> int:
    """CRC-32 of a text of CRC-32 a followed by one of n bytes of CRC-32 b: a is moved by 8 n places in the polynomial field."""

    def times(x: int, y: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            out ^= y if x >> k & 1 else 0
            y = y >> 1 ^ (0xEDB88320 if y & 1 else 0)
        return out

    move, power, left = 1 << 31, 1 << 23, n  # 1 and x**8
    while left:
        move = times(move, power) if left & 1 else move
        power, left = times(power, power), left >> 1
    return times(move, a) ^ b


#: How often a shard has an id.
_COUNT = np.dtype([("id", "<u4"), ("n", "<i8")])


def _raw_blocks(docs: DataFrame, path: str, pattern: str | None, end: int, dtype: str, size: int) -> DataFrame:
    """shard, block, lead, ids, doc_ids, sizes, counts: each shard's ids in blocks.

    sizes has each document's ids within the block; lead is how many ids of the first one lie in blocks before; counts, in the
    last block of a shard, has how often the shard has each of size ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shard = _kept(path, pattern, dtype), TaskContext.get().partitionId()
        width, ending = np.dtype(dtype).itemsize, np.array([end], dtype).tobytes()
        held, owners, sizes, filled, lead, block = bytearray(), [], [], 0, 0, 0
        met, waiting, doc_type = np.zeros(size, np.int64), None, None

        def row(values: list, counts: bytes | None = None) -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(doc_type), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*values, counts], types, strict=True)], ["shard", "block", "lead", "ids", "doc_ids", "sizes", "counts"])

        for batch in batches:
            doc_type, texts, at = batch.schema.field("doc_id").type, batch.column("text"), 0
            for data, own in ids.encode_all(texts, ending):
                held += data
                met += np.bincount(np.frombuffer(data, dtype), minlength=size)
                for owner, left in zip(batch.column("doc_id").slice(at, len(own)).to_pylist(), (own // width).tolist(), strict=True):
                    before = 0
                    while left:
                        part = min(BLOCK - filled, left)
                        if not sizes:
                            lead = before
                        owners.append(owner)
                        sizes.append(part)
                        left, before, filled = left - part, before + part, filled + part
                        if filled == BLOCK:
                            if waiting:
                                yield row(waiting)
                            waiting = [shard, block, lead, bytes(held[: BLOCK * width]), owners, sizes]
                            del held[: BLOCK * width]
                            owners, sizes, filled, block = [], [], 0, block + 1
                at += len(own)
        if sizes:
            if waiting:
                yield row(waiting)
            waiting = [shard, block, lead, bytes(held), owners, sizes]
        if waiting:  # a shard's last block brings its counts
            at = np.flatnonzero(met)
            yield row(waiting, np.rec.fromarrays([at, met[at]], _COUNT).tobytes())

    estimate = input_bytes(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if estimate < 1 << 60:  # else Spark knows no size
        n = max(n, estimate // SHARD_BYTES)
    # the last key deals rows that are equal in both others
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_at"))
    order = [F.col("doc_id").asc_nulls_first(), "_h", "_at"]
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return dealt.mapInArrow(run, f"shard int, block long, lead long, ids binary, doc_ids array<{kind}>, sizes array<int>, counts binary")


def _counts(raw: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; one row per id of the vocabulary reaches the driver.

    A task sends as many rows as it met ids, so it adds up the shards of COUNT_BYTES of blocks, however small the files are.
    """
    tasks = max(raw.sparkSession.sparkContext.defaultParallelism, input_bytes(raw) // COUNT_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                own = np.frombuffer(counts.as_buffer(), _COUNT)
                total[own["id"]] += own["n"]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in raw.where("counts is not null").select("counts").coalesce(tasks).mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_ids(docs: DataFrame, folder: str, tokenizer: str, pattern: str | None = None, end: int = END_ID) -> None:
    """Write the ids of docs(doc_id, text), each document's followed by end, in ascending doc_id order under folder.

    pattern is the one that byte-level vocabularies cut texts by; without it every text goes through the library whole.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    size = max([end, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    raw = materialise(_raw_blocks(docs, tokenizer, pattern, end, dtype, size))
    freq = scaled(_counts(raw, size))
    table = Table(freq)
    kind = raw.schema["doc_ids"].dataType.simpleString()

    def coded(rows: list[tuple[dict, np.ndarray]], schema: pa.Schema) -> pa.RecordBatch:
        steps = -(-len(rows[0][1]) // LANES)
        grid = np.full((len(rows), steps * LANES), table.filler, np.int64)
        for at, (_, ids) in enumerate(rows):
            grid[at, : len(ids)] = ids
        made = table.encode(grid.reshape(len(rows), steps, LANES))
        return pa.RecordBatch.from_pylist(
            [
                r | {"n_ids": len(ids), "crc": zlib.crc32(ids.astype("<u4").tobytes()), "table_crc": table.crc, "states": states, "places": places, "words": words}
                for (r, ids), (words, states, places) in zip(rows, made, strict=True)
            ],
            schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: list[tuple[dict, np.ndarray]] = []
        for batch in batches:
            own = [batch.schema.field(c) for c in ("shard", "block", "lead", "doc_ids", "sizes")]
            schema = pa.schema([*own, ("n_ids", pa.int32()), ("crc", pa.int64()), ("table_crc", pa.int64()), ("states", pa.binary()), ("places", pa.list_(pa.int32())), ("words", pa.binary())])
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids = np.frombuffer(r.pop("ids"), dtype)
                if len(ids) < BLOCK:
                    yield coded([(r, ids)], schema)
                else:
                    full.append((r, ids))
                if len(full) == TOGETHER:
                    yield coded(full, schema)
                    full = []
        if full:
            yield coded(full, schema)

    form = f"shard int, block long, lead long, doc_ids {kind}, sizes array<int>, n_ids int, crc long, table_crc long, states binary, places array<int>, words binary"
    blocks = materialise(raw.drop("counts").mapInArrow(run, form))
    release(raw)
    blocks.repartitionByRange("shard", "block").sortWithinPartitions("shard", "block").write.option("compression", "none").parquet(f"{folder}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))  # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"), "n_ids").write.parquet(f"{folder}/shards")
    spark.createDataFrame(list(enumerate(freq.tolist())), "id int, freq long").coalesce(1).write.parquet(f"{folder}/frequencies")
    release(blocks)


def _table(spark: SparkSession, folder: str) -> Table:
    rows = spark.read.schema("id int, freq long").parquet(f"{folder}/frequencies").collect()  # at most the vocabulary
    freq = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return Table(freq)


def read_pieces(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """shard, place (of a document's first id within the shard), lead, doc_id, n_ids, crc, ids (or null) for each document's
    part of each block, decoded and checked; a document in several blocks is the sum of its parts in order of lead."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    table = _table(spark, folder)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def parts(rows: list[dict], slots: np.ndarray, doc_type: pa.DataType) -> pa.RecordBatch:
        steps = -(-rows[0]["n_ids"] // LANES)
        marks = len(rows[0]["places"])
        words = [np.frombuffer(r["words"], "<u4") for r in rows]
        begin = np.cumsum([0, *map(len, words)])[:-1]
        states = np.concatenate([np.frombuffer(r["states"], "<u8").reshape(-1, LANES) for r in rows])
        places = np.concatenate([np.array(r["places"]) + b for r, b in zip(rows, begin, strict=True)])
        # parts of one block begin at its checkpoints; the last may have fewer steps, what it decodes beyond them is left out
        ids = table.decode(slots, np.concatenate(words), states, places, min(table.mark, steps)).reshape(len(rows), -1)
        out: dict[str, list] = {c: [] for c in ("shard", "place", "lead", "doc_id", "n_ids", "crc", "ids")}
        for r, own in zip(rows, ids, strict=True):
            data = own[: r["n_ids"]].astype("<u4").tobytes()
            if zlib.crc32(data) != r["crc"] or r["table_crc"] != table.crc:
                raise ValueError(f"block {r['block']} of shard {r['shard']} is damaged")
            at = 0
            for i, (doc, n) in enumerate(zip(r["doc_ids"], r["sizes"], strict=True)):
                lead = 0 if i else r["lead"]
                piece = data[4 * at : 4 * (at + n)]
                for c, v in zip(out, (r["shard"], r["block"] * BLOCK + at - lead, lead, doc, n, zlib.crc32(piece), piece if with_ids else None), strict=True):
                    out[c].append(v)
                at += n
        types = [pa.int32(), pa.int64(), pa.int64(), doc_type, pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, full = table.slots(), []
        for batch in batches:
            doc_type = batch.schema.field("doc_ids").type.value_type
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if r["n_ids"] < BLOCK:
                    yield parts([r], slots, doc_type)
                else:
                    full.append(r)
                if len(full) == TOGETHER:
                    yield parts(full, slots, doc_type)
                    full = []
        if full:
            yield parts(full, slots, doc_type)

    return blocks.mapInArrow(run, f"shard int, place long, lead long, doc_id {kind}, n_ids int, crc long, ids binary")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    pieces = read_pieces(spark, folder).groupBy("shard", "place")
    parts = F.array_sort(F.collect_list(F.struct("lead", "n_ids", "crc"))).alias("parts")
    whole = materialise(pieces.agg(F.first("doc_id").alias("doc_id"), F.sum("n_ids").alias("n_tokens"), F.min("crc").alias("crc"), parts))  # decoded once
    kind = whole.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for crc, parts in zip(batch.column("crc").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                for p in parts:
                    crc = p["crc"] if p is parts[0] else crc_of_both(crc, p["crc"], 4 * p["n_ids"])
                sums.append(crc)
            keep = [batch.column(c) for c in ("shard", "place", "doc_id", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sums, pa.int64())], ["shard", "place", "doc_id", "n_tokens", "ids_crc32"])

    one = F.size("parts") == 1  # documents within a block need no joining of sums
    columns = ["shard", "place", "doc_id", "n_tokens"]
    split = whole.where(~one).select(*columns, "crc", "parts").mapInArrow(run, f"shard int, place long, doc_id {kind}, n_tokens long, ids_crc32 long")
    both = whole.where(one).select(*columns, F.col("crc").alias("ids_crc32")).unionByName(split)
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "first")
    return both.join(shards, "shard").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/sparktab-ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir, "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return digests(spark, folder)
