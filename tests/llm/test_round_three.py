"""The prefix trie, token-id files and phrases against brute-force versions, with nulls, ties, repeats and odd columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktab.llm import phrases, prefixtrie, tokenids

CLASH = ["depth", "kx", "row", "n", "k1", "f", "lang_", "shard", "place", "words"]


def plain(rows):
    return sorted((tuple("" if pd.isna(v) else (v if isinstance(v, str) else int(v)) for v in r) for r in rows), key=lambda r: list(map(str, r)))


# 11 prefix trie


def turns(seed=1):
    """(conv_id, turn, role, text): shared openings, a long one, ties, nulls, repeats, a block without its first conversation."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), 100, 101, 102, 150, 207, 208, 299]:
        n = 150 if c == 7 else rng.randint(1, 9)
        for t in range(n):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "ok", "why", "größe 😀", None])))
    rows += [(3, 4, None, "tie b"), (3, 4, None, "tie a"), (3, 4, "user", "tie a"), (3, None, "user", "first"), (3, None, "user", "first")]
    rows += [(None, 0, "user", "of nobody"), (500, 0, "user", "alone"), (501, 0, None, None)]
    return rows


def trie_by_brute_force(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    for c in own:
        own[c] = [(r, x) for _, _, r, x in sorted(own[c], key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))]
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + t[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in sorted(built.items()):
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    out = []
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        digest = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        out.append((m[0], len(node), members[node[:-1]][0] if node else None, len(m), sum(len(n) == len(node) + 1 for n in below), sum(n not in inner for n in below), saved, digest))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("band", [3, 64])
def test_trie_equals_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(prefixtrie, "BAND", band)  # 3: bands of bands of bands
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASH})
    got = prefixtrie.prefix_trie(df.repartition(5)).select(*COLUMNS).collect()
    assert plain(got) == plain(trie_by_brute_force(turns()))


def test_trie_of_nothing_and_of_one_long_text(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, 0, "user", "ab " * 200_000), (5, 1, "user", ""), (6, 0, "user", "ab " * 200_000)]
    assert plain(prefixtrie.prefix_trie(spark.createDataFrame(rows, schema)).select(*COLUMNS).collect()) == plain(trie_by_brute_force(rows))


def test_trie_equals_its_sql_on_deep_conversations(spark, tmp_path):
    rows = [r for r in turns(2) if r[0] != 7]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(prefixtrie.ORACLE).df()[COLUMNS]
    assert plain(prefixtrie.prefix_trie(df).select(*COLUMNS).collect()) == plain(want.astype(object).itertuples(index=False))


# 12 token ids


def texts(seed=4):
    rng = random.Random(seed)
    words = ["the", "Größe", "naïve", "don't", "it's", "x" * 70, "12345", "日本語テキスト", "a.b,c", "…", "<|endoftext|>", "😀😀", "é"]
    out = ["", None, " ", "  two  spaces ", "\n\n line\n  next \t tab\r\n", "<|endoftext|>", "a  <|endoftext|> b", "no break space", "\x1c\x1d ctrl", "end \n", "x\ny", "x\n\ny", "x \ny", "word.\nNext", "a\n's"]
    for _ in range(60):
        out.append(rng.choice(["", " "]) + rng.choice([" ", "  ", "\n", " \n", ". ", ".\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 60))))
    return [*out, "long words here. " * 9000, out[20], out[20]]


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def test_ids_of_texts_equal_the_library(vocabulary):
    ids, lib = tokenids.Ids(*vocabulary, "<u2"), library(vocabulary[0])
    for t in texts():
        assert np.frombuffer(ids.encode(t or ""), "<u2").tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]


def ids_of_all(ids, texts):
    out = []
    for data, sizes in ids.encode_all(pa.array(texts, pa.string()), b"\x02\x00"):
        ends = np.cumsum(sizes // 2).tolist()
        out += [np.frombuffer(data, "<u2")[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ids_of_texts_side_by_side_equal_the_library(vocabulary, monkeypatch, small):
    if small:  # slices of a few texts, calls of a few words, caches that are left behind
        for name, value in (("SLICE_BYTES", 60), ("CALL", 3), ("CACHE", 20), ("LONG_PIECE", 4)):
            monkeypatch.setattr(tokenids, name, value)
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "Bc", "é", "ÿ", "×", "÷", "ł", "07", "²", "'", "'s", "'re", "’"]
    parts += [".", ",", "#", "\0", "\x7f", "日", "я", "한", "😀", "e\u0301", "\u200d", "٣", "<|endoftext|>", "<|endof", "the", "word" * 20]
    some = ["", None, "", " ", "a  ", "b", "\n", "c\n", "d", *("".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500))]
    lib = library(vocabulary[0])
    want = [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in some]
    array = pa.array(["x", *some], pa.string()).slice(1)
    assert ids_of_all(tokenids.Ids(*vocabulary, "<u2"), some) == want
    assert ids_of_all(tokenids.Ids(*vocabulary, "<u2"), array) == want
    assert ids_of_all(tokenids.Ids(vocabulary[0], None, "<u2"), some) == want


def test_new_words_share_calls_and_known_ones_make_none(vocabulary):
    ids, calls = tokenids.Ids(*vocabulary, "<u2"), []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, *args, **options):
            calls.append(1)
            return self.library.encode_batch_fast(*args, **options)

    ids.by_line = Counted(ids.by_line)
    words = [f"{a}{b}{c}" for a in ("ere", "ion", "über") for b in ("tha", "qué", "zu") for c in "abcdefghijklmnopqrstuvwxyz"]
    first = ids_of_all(ids, [" ".join(words) + ".", ", ".join(words)])
    made = len(calls)
    assert made <= 2 + 2 * len(words) // tokenids.CALL  # the words, and the marks
    assert ids_of_all(ids, [" ".join(words) + ".", ", ".join(words)]) == first
    assert len(calls) == made


def expected(rows, lib):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_the_ids_back(spark, vocabulary, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenids, "BLOCK", 1 << 10)  # many blocks a document
    monkeypatch.setattr(tokenids, "MARK", 4)
    rows = [(3 * i - 20, t) for i, t in enumerate(texts())] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    folder = str(tmp_path / "ids")
    tokenids.write_ids(df, folder, *vocabulary)
    lib = library(vocabulary[0])
    assert plain(tokenids.digests(spark, folder).collect()) == plain(expected(rows, lib))
    # the ids themselves, by pieces
    shards = {r["shard"]: r["first"] for r in spark.read.parquet(f"{folder}/shards").collect()}
    pieces = sorted((shards[r["shard"]] + r["place"] + r["lead"], bytes(r["ids"])) for r in tokenids.read_pieces(spark, folder, True).collect())
    want = [i for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in lib.encode(t or "", add_special_tokens=False).ids + [2]]
    assert np.frombuffer(b"".join(p for _, p in pieces), "<u4").tolist() == want


def test_files_without_a_pattern_and_of_nothing(spark, vocabulary, tmp_path):
    rows = [(2, "b a"), (1, "c"), (1, "c"), (7, None)]
    tokenids.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), vocabulary[0])
    assert plain(tokenids.digests(spark, str(tmp_path / "a")).collect()) == plain(expected(rows, library(vocabulary[0])))
    tokenids.write_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b"), *vocabulary)
    assert tokenids.digests(spark, str(tmp_path / "b")).count() == 0


def test_a_damaged_block_is_refused(spark, vocabulary, tmp_path):
    tokenids.write_ids(spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string"), str(tmp_path / "a"), *vocabulary)
    blocks = spark.read.parquet(str(tmp_path / "a/blocks"))
    bad = blocks.withColumn("words", F.expr("concat(substring(words, 1, 8), unhex(if(hex(substring(words, 9, 1)) = 'FF', '00', 'FF')), substring(words, 10, length(words)))"))
    bad.write.parquet(str(tmp_path / "b/blocks"))
    for part in ("frequencies", "shards"):
        spark.read.parquet(str(tmp_path / "a" / part)).write.parquet(str(tmp_path / "b" / part))
    with pytest.raises(Exception, match="damaged"):
        tokenids.digests(spark, str(tmp_path / "b")).collect()


def test_coder_round_trip_of_skewed_and_single_symbols():
    rng = np.random.default_rng(1)
    for symbols in (rng.zipf(1.3, 4096) % 300, np.full(4096, 5), rng.integers(0, 50_000, 4096)):
        table = tokenids.Table(tokenids.scaled(np.bincount(symbols, minlength=50_257)), 16)
        grid = symbols.reshape(2, -1, tokenids.LANES)
        for got, (words, states, places) in zip(grid, table.encode(grid), strict=True):
            state = np.frombuffer(states, "<u8").reshape(-1, tokenids.LANES)
            back = table.decode(table.slots(), np.frombuffer(words, "<u4"), state, np.array(places), 16)
            assert (back.reshape(-1)[: got.size] == got.reshape(-1)).all()


def test_checksums_join():
    a, b = b"some bytes", b"more of them" * 9
    assert tokenids.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# 13 phrases


def phrase_rows(seed=6):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Über", " ", "x" * 300, "x" * 301]
    rows = []
    for i in range(150):
        body = rng.choice([" ", "  ", "\t"]).join(rng.choice(words[: rng.randint(2, 34)]) for _ in range(rng.randint(0, 60)))
        rows.append((body + rng.choice([". Of the People, by", "\nof THE people", ";", ""]), rng.choice(["en", "de", None, "und"])))
    return rows + [("copy of one line. " * 40, "en"), (None, "en"), ("", None), (".,;", "de"), ("a a a a a a a a", "fr"), ("rare", "xx")] + [("the same text over and over", "it")] * 12


def phrases_by_brute_force(rows, least, top, longest=5):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in phrases.re.split("[.,;:!?\n\x0b\x0c\r]", t):
            w = [x for x in phrases.re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        held = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in held.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(a, inner.get(p[i : i + k], 0))
        kept = []
        for p, a in held.items():
            if inner.get(p, 0) < a:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize("least,top", [(5, 2000), (12, 7)])
def test_phrases_equal_brute_force(spark, least, top):
    df = spark.createDataFrame(phrase_rows(), "text string, lang string").withColumns({c: F.lit("x") for c in CLASH}).repartition(4)
    got = phrases.collocations(df, least=least, top=top).collect()
    want = phrases_by_brute_force(phrase_rows(), least, top)
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("wrong", ["empty", "full", "crowded"])
def test_phrases_do_not_depend_on_the_sample(spark, monkeypatch, wrong):
    """A sample that proposes nothing, one that is everything, and a bitmap that all phrases share."""
    if wrong == "empty":
        monkeypatch.setattr(phrases, "piece_sample", lambda docs: docs.where("false"))
    elif wrong == "full":
        monkeypatch.setattr(phrases, "piece_sample", lambda docs: docs)
    else:
        monkeypatch.setattr(phrases, "SPARE", 0)
    df = spark.createDataFrame(phrase_rows(), "text string, lang string")
    got = phrases.collocations(df, least=8).collect()
    assert sorted(map(tuple, got)) == sorted(phrases_by_brute_force(phrase_rows(), 8, 2000))


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_shuffled_phrase_keys_have_96_bits(spark):
    docs = spark.createDataFrame([("a b a b", -(2**63) + 5, -7), ("a b", 9, 2**63 - 1)], "text string, s1 long, s2 long")
    counted = phrases._count(docs, [np.full(64, 2**64 - 1, np.uint64)], 1, totals=True)
    assert counted.dtypes == [("k1", "bigint"), ("k2", "int"), ("f", "bigint")]
    seeds = counted.where("f = 0").select("k1", "k2")
    assert sorted(r["f"] for r in counted.where("f > 0").join(seeds, ["k1", "k2"]).collect()) == [2, 4]
    assert counted.where("f > 0").agg(F.sum("f")).first()[0] == 6 + 4 + 3 + 2 + 1 + 3
