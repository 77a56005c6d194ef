"""Toxicity by a subsequence string-kernel SVM on Nystroem landmarks.

A text is its sentences, and a sentence its words, each written as letters: accents and inner punctuation go, digits and
signs that stand for letters become those, letters beyond a-z are folded onto them, runs of single spaced letters are
joined. Two strings share a gapped trigram if its letters occur in both in order within SPAN places; a trigram weighs DECAY
per place that it spans, so inserted or skipped letters weaken a match without ending it. A word's kernel with a landmark is
the largest normalised kernel of its windows of the landmark's length or one more, and a sentence's that of its words;
values under LEAST, which unrelated words reach, are 0. Kernels to the power of POWER, itself a kernel that sets near matches
apart from chance ones, times the inverse root of the landmarks' matrix of such kernels are the Nystroem features of a
linear SVM with squared hinge loss. Landmarks are pieces of words that cover the toxic training texts greedily.

The SVM learns from the sentences of labelled texts. Which sentence makes a text toxic isn't labelled: at first every
sentence has its text's label, then, ROUNDS times over, a toxic text stands for its sentence of largest margin, whatever that is;
no toxic text is left out. A text's margin is its sentences' largest, and a sigmoid, fitted to the margins of labelled texts
that neither landmarks nor weights were learned from, turns it into the score: the likelihood of label 1.

Learned only from labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most about TRAIN_ROWS of them, chosen by a
hash of doc_id and text, each of TRAIN_BYTES at most and all of about TRAIN_TOTAL at most. Labels, lang, source and doc_id
are no inputs of a score.

Defined results: null, empty and wordless texts score as a text of one sentence without a match; without labels of both
classes, or without a landmark, every score is the share of toxic training rows (0 without any); a doc_id with several
labels is toxic if one says so; rows that share a doc_id stay separate; other columns are not looked at. Long words are read
in overlapping pieces, long texts whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, fresh, materialise, table, text_hash

TRAIN_ROWS, TRAIN_BYTES, TRAIN_TOTAL, LANDMARKS = 4000, 200_000, 64_000_000, 64
SPAN, DECAY, LEAST, POWER, FOLDS, ROUNDS = 6, 0.6, 0.5, 3, 5, 1
#: One labelled text in so many is kept for the sigmoid.
CALIBRATION = 4
#: Letters of a piece of a long word, words that a Python worker keeps, characters read at a time.
PIECE, CACHE, SLICE_CHARS = 24, 300_000, 500_000
#: Signs written for letters.
LETTER_SIGNS = str.maketrans("0134578@$", "oieastbas")
_SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:[ \t]\S){2,}(?=\s|$)")
_SENTENCE = re.compile(r"[.!?\n]+")
_OTHER = re.compile("[^a-z]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_START = "`"  # the character before a; stands before each word


def letters(word: str) -> str:
    """The word as letters a-z; other letters are folded onto them by their number."""
    word = _EDGE.sub("", word).casefold()
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
        word = "".join(c if c.isascii() else chr(97 + ord(c) % 26) for c in word if c.isascii() or c.isalpha())
    return _OTHER.sub("", word if word.isalpha() else word.translate(LETTER_SIGNS))


def tokens(text: str) -> set[str]:
    """Distinct words of a text, runs of spaced letters joined as words of their own."""
    found = set(text.split())
    found.update("".join(m.split()) for m in _SPACED.findall(text))
    return found


def pieces(word: str) -> list[str]:
    """A word of letters with its start mark, or overlapping pieces of it if it is long."""
    word = _START + word
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (T, 3) of the gapped trigrams of a string of n letters, and their weights."""
    if n not in _TRIPLES:
        at = np.array([(i, i + a, i + b) for i in range(n) for a, b in combinations(range(1, SPAN), 2) if i + b < n], np.int64).reshape(-1, 3)
        _TRIPLES[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    return _TRIPLES[n]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (words, T) of the gapped trigrams of strings of one length, and the weights (T,)."""
    n = len(words[0])
    raw = np.frombuffer("".join(words).encode(), np.uint8).reshape(len(words), n).astype(np.int32) - ord(_START)
    at, weights = triples(n)
    return raw[:, at[:, 0]] * 729 + raw[:, at[:, 1]] * 27 + raw[:, at[:, 2]], weights


class Kernel:
    """Kernels of words with landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        maps = np.zeros((len(landmarks), 27**3), np.float32)
        for row, mark in zip(maps, landmarks, strict=True):
            codes, weights = trigrams([mark])
            np.add.at(row, codes[0], weights)
        norms = np.sqrt((maps**2).sum(1))
        unit = maps / norms[:, None]
        self.gram = (unit @ unit.T).astype(np.float64)
        self.unit = np.ascontiguousarray(unit.T)
        self.most = (maps / (norms**2)[:, None]).max(0)
        self.lengths = sorted({len(m) + d for m in landmarks for d in (0, 1)})
        self.known: dict[str, np.ndarray | None] = {}

    def maybe(self, words: list[str]) -> np.ndarray:
        """Which strings of one length may reach LEAST: their trigrams, at the most any landmark gives them, do."""
        out = np.zeros(len(words), bool)
        for at in range(0, len(words), 2048):
            codes, weights = trigrams(words[at : at + 2048])
            out[at : at + 2048] = self.most[codes] @ weights >= LEAST
        return out

    def of_strings(self, words: list[str]) -> np.ndarray:
        """(strings, landmarks): normalised kernels of strings of one length."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for at in range(0, len(words), 64):
            codes, weights = trigrams(words[at : at + 64])
            norms = np.einsum("wij,i,j->w", codes[:, :, None] == codes[:, None, :], weights, weights)
            out[at : at + 64] = np.einsum("wtl,t->wl", self.unit[codes], weights) / np.sqrt(norms)[:, None]
        return out

    def learn(self, new: list[str]) -> None:
        """Put words into the cache: the largest kernels of their windows, or None where all are below LEAST."""
        by_length: dict[int, list[tuple[str, str]]] = {}
        for word in new:
            self.known[word] = None
            if len(plain := letters(word)) >= 3:
                for piece in pieces(plain):
                    by_length.setdefault(len(piece), []).append((word, piece))
        windows: dict[int, list[tuple[str, str]]] = {}
        for held in by_length.values():
            for i in np.flatnonzero(self.maybe([p for _, p in held])):
                word, piece = held[i]
                for n in {min(n, len(piece)) for n in self.lengths}:
                    windows.setdefault(n, []).extend((word, w) for w in {piece[j : j + n] for j in range(len(piece) - n + 1)})
        for n, held in windows.items():
            values = self.of_strings([w for _, w in held])
            # a landmark is held against windows of its own length and one more; shorter words are windows themselves
            values[(values < LEAST) | ~self.fits(n)] = 0
            for i in np.flatnonzero(values.any(1)):
                old = self.known[held[i][0]]
                self.known[held[i][0]] = values[i] if old is None else np.maximum(old, values[i])

    def fits(self, n: int) -> np.ndarray:
        own = np.array([len(m) for m in self.landmarks])
        return (n <= own + 1) & (n >= own - 2)

    def of_texts(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """For each text (sentences, landmarks): kernels of its sentences with a match, and how many sentences it has."""
        out: list[tuple[np.ndarray, int]] = []
        held: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= SLICE_CHARS or i == len(texts) - 1:
                out += self._of_slice(held)
                held, size = [], 0
        return out

    def _of_slice(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        words = [tokens(t) for t in texts]
        every = set().union(*words)
        if new := [w for w in every if w not in self.known]:
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = list(every)
            self.learn(new)
        hits = {w for w in every if self.known[w] is not None}
        out = []
        for text, own in zip(texts, words, strict=True):
            if own.isdisjoint(hits):
                out.append((np.zeros((0, len(self.landmarks)), np.float32), 1))
                continue
            parts = [x for x in _SENTENCE.split(text) if x.strip()]
            found = [hits.intersection(tokens(x)) for x in parts]
            rows = [np.max([self.known[w] for w in f], 0) for f in found if f]
            if not rows:  # of a word that a sentence's end cuts
                rows = [np.max([self.known[w] for w in own & hits], 0)]
            out.append((np.array(rows, np.float32), max(1, len(parts))))
        return out


def grams(word: str) -> set[str]:
    word = _START + word
    return {word[i : i + n] for n in range(5, 11) for i in range(len(word) - n + 1)}


def copies(sets: list[set[str]]) -> np.ndarray:
    """For each set of words the number of its group of near copies: sets that agree in a band of 6 of 72 minimum hashes."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(1, 2**32, (2, 72), dtype=np.uint64) | np.uint64(1)
    root = list(range(len(sets)))
    seen: dict[tuple, int] = {}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, words in enumerate(sets):
        if words:
            x = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
            low = ((x[:, None] * a + b) >> np.uint64(24) & np.uint64(2**32 - 1)).min(0).reshape(12, 6)
            for band, key in enumerate(map(tuple, low.tolist())):
                root[top(i)] = top(seen.setdefault((band, *key), i))
    return np.array([top(i) for i in range(len(sets))], np.int64)


def choose_landmarks(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Pieces of words that many toxic texts hold and few others, chosen greedily; each one a text holds makes it count less."""
    known: dict[str, str] = {}
    for w in set().union(*map(tokens, texts)):
        known[w] = letters(w)
    plain = [{p for w in tokens(t) if 3 <= len(p := known[w]) <= 40} for t in texts]
    share = float(toxic.mean())
    # so many that hardly any of a hundred thousand pieces is in toxic texts alone by chance
    enough = max(3, math.ceil(math.log(1e-8) / math.log(min(share, 0.5))))
    # near copies speak with one voice
    bad = np.flatnonzero(toxic)
    group = np.arange(len(texts))
    group[bad] = bad[copies([plain[i] for i in bad])]
    words_of: dict[int, set[str]] = {}
    for i in bad:
        words_of.setdefault(int(group[i]), set()).update(plain[i])
    # counts by hash first: pieces that too few texts hold never get an entry
    slots = np.zeros(1 << 22, np.int32)
    for words in words_of.values():
        codes = np.fromiter((zlib.crc32(g.encode()) for w in words for g in grams(w)), np.int64)
        slots[np.unique(codes & (len(slots) - 1))] += 1
    counts: Counter[str] = Counter()
    for words in words_of.values():
        counts.update({g for w in words for g in grams(w) if slots[zlib.crc32(g.encode()) & (len(slots) - 1)] >= enough})
    counts = Counter({g: n for g, n in counts.items() if n >= enough})
    limit = {g: 0.05 * n * (1 - share) / share for g, n in counts.items()}
    clean: Counter[str] = Counter()
    for word, n in Counter(w for i in np.flatnonzero(~toxic) for w in plain[i]).most_common():
        for gram in grams(word) & limit.keys():
            clean[gram] += n
            if clean[gram] > limit[gram]:
                del limit[gram]
    at: dict[str, list[int]] = {}
    rest: dict[str, set[str]] = {}
    for i in bad:
        for word in plain[i]:
            if own := grams(word) & limit.keys():
                at.setdefault(word, []).append(int(group[i]))
                for gram in own:
                    rest.setdefault(gram, set()).add(word)
    weight, marks = np.ones(len(texts)), []
    while rest and len(marks) < most:
        held = {g: np.unique([i for w in words for i in at[w]]) for g, words in rest.items()}
        gains = {g: float(weight[h].sum()) for g, h in held.items()}
        best = max(gains, key=lambda g: (gains[g], len(g), g))
        # the longest piece around it that holds nearly as much
        best = max((g for g in rest if best in g and gains[g] >= 0.9 * gains[best]), key=lambda g: (len(g), gains[g], g))
        if len(held[best]) < enough:
            break
        marks.append(best)
        weight[held[best]] *= 0.8
        # words that hold it speak for no other piece
        done = rest[best]
        rest = {g: left for g, words in rest.items() if (left := words - done)}
        rest = {g: words for g, words in rest.items() if len({i for w in words for i in at[w]}) >= enough}
    return marks


class Model:
    """A trained scorer; of fixed size, so it travels in the task's closure."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.kernel = None
        toxic = np.asarray(toxic, bool)
        self.flat = float(toxic.mean()) if len(toxic) else 0.0
        aside = np.array([zlib.crc32(t.encode()) % CALIBRATION == 0 for t in texts], bool)
        if len({*toxic[aside].tolist()}) < 2 or len({*toxic[~aside].tolist()}) < 2:
            aside[:] = False  # too few of a class to keep some aside
        some = np.flatnonzero(~aside)
        marks = choose_landmarks([texts[i] for i in some], toxic[some]) if toxic.any() and not toxic.all() else []
        if not marks:
            return
        kernel = Kernel(marks)
        values, vectors = np.linalg.eigh(kernel.gram**POWER)
        self.root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        bags = [(self.features(rows), n) for rows, n in kernel.of_texts(texts)]
        none = self.features(np.zeros((1, len(marks))))

        def sentences(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rows and weights: sentences with a match, and one row for all without."""
            rows = np.concatenate([none, *[bags[i][0] for i in which]])
            empty = sum(bags[i][1] - len(bags[i][0]) for i in which)
            return rows, np.concatenate([[empty], np.ones(len(rows) - 1)])

        clean, clean_weights = sentences(some[~toxic[some]])
        bad, bad_weights = sentences(some[toxic[some]])
        for _ in range(1 + ROUNDS):
            sign = np.concatenate([-np.ones(len(clean)), np.ones(len(bad))])
            self.weights = _svm(np.concatenate([clean, bad]), sign, np.concatenate([clean_weights, bad_weights]))
            best = [np.concatenate([none, bags[i][0]]) for i in some[toxic[some]]]
            bad = np.array([rows[np.argmax(rows @ self.weights)] for rows in best])
            bad_weights = np.ones(len(bad))
        fitted = np.flatnonzero(aside) if aside.any() else some
        self.slope, self.shift = _sigmoid(np.array([self.margin(bags[i][0]) for i in fitted]), toxic[fitted])
        kernel.known = {}
        self.kernel = kernel

    def features(self, kernels: np.ndarray) -> np.ndarray:
        return np.c_[kernels**POWER @ self.root, np.ones(len(kernels))]

    def margin(self, rows: np.ndarray) -> float:
        """A text's margin: its sentences' largest, that of a sentence without a match at least; what exceeds 1 counts little."""
        most = float(max(self.weights[-1], (rows @ self.weights).max(initial=-np.inf)))
        return most if most <= 1 else 1 + (most - 1) / 10

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.flat)
        margins = np.array([self.margin(self.features(rows)) for rows, _ in self.kernel.of_texts(texts)])
        return 1 / (1 + np.exp(-np.clip(margins * self.slope + self.shift, -30, 30)))


def _svm(x: np.ndarray, sign: np.ndarray, weights: np.ndarray, penalty: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, both classes of one weight, by Newton steps inside the margin."""
    weights = weights / np.where(sign > 0, weights[sign > 0].sum(), weights[sign < 0].sum()) / 2
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = sign * (x @ w) < 1
        a, share = x[inside], weights[inside]
        new = np.linalg.solve(a.T @ (a * share[:, None]) + penalty * np.eye(len(w)), a.T @ (sign[inside] * share))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new if not _ else (w + new) / 2
    return w


def _sigmoid(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic fit to margins, with Platt's smoothed targets."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    aim = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[margins, np.ones(len(margins))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - aim) + 1e-3 * w)
    return float(max(w[0], 1e-3)), float(w[1])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), held-out rows left aside."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    if n > TRAIN_ROWS:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * TRAIN_ROWS / n)))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    some = docs.select("doc_id", "text", size.alias("size")).where(F.col("size") <= TRAIN_BYTES).join(labels, "doc_id")
    # bounded once more, as rows may share a doc_id and texts may be long
    some = materialise(some)
    rows, total = some.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, TRAIN_ROWS / max(1, rows), TRAIN_TOTAL / max(1, total))
    if rows > 1.2 * TRAIN_ROWS or total > TRAIN_TOTAL:
        some = some.where(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text", F.rand(7)), F.lit(1 << 30)) < F.lit(int((1 << 30) * share)))
    some = some.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "doc_id").toPandas().sort_values(["doc_id", "text"])
    return Model(some["text"].tolist(), some["toxic"].to_numpy() > 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = pa.array(model.scores([t or "" for t in texts]), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_key", "held_out")), scores], ["doc_id", "text_key", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("text_key"), held_out().alias("held_out"), "text")
    out = rows.mapInArrow(run, f"doc_id {kind}, text_key long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on them and the labels table, doesn't call toxic; with the columns of docs."""
    model = train(docs, table(spark, sf_dir, "labels"))
    key = fresh(docs, "_toxic_score")[0]
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.scores([t or "" for t in batch.column(position).to_pylist()]), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, key])

    schema = StructType([*docs.schema.fields, StructField(key, DoubleType())])
    return docs.mapInArrow(run, schema).where(F.col(key) < 0.5).drop(key)
