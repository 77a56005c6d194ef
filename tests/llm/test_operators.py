"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import hashlib
import random
import zlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktab.llm import chat, decontaminate, licenses, linededup, mixing, neardup, shingles, substrings, suffixes, tokens, topk, toxicity

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=3):
    """(doc_id, text, source) rows with copies, near copies, nulls, blanks, repeats and one long text."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(12)]
    rows = [(i, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(base)]
    rows += [(20, base[0], "s0"), (21, base[0], "s0"), (22, base[1] + " one more word", "s0"), (23, "x" + base[2][1:], "s0")]
    rows += [(30, None, "s1"), (31, "", "s1"), (32, " \t\n", None), (33, "One", "s1"), (34, "one", "s1"), (35, "Ünï çödé " + base[3], "s2")]
    rows += [(40, prose(rng, 6000) + " " + base[4], "s2"), (41, base[5], "s1"), (41, base[5], "s1"), (None, base[6], "s2"), (42, "a" * 300, "s2"), (43, "a" * 120, "s2")]
    return rows


CLASH = ["n_words", "size", "shard", "key", "hits", "minimum", "lines", "words", "rank", "text_key", "component", "_gone_id", "_hit_id", "_cut_id", "mix_taken", "_toxic_score", "at", "a", "b"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("extra") for c in CLASH}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 1 toxicity


def toxic_texts(n=600, seed=5):
    rng = random.Random(seed)
    insults = ["idiot", "moron", "worthless", "pathetic"]
    texts, bad = [], []
    for i in range(n):
        words = ["".join(rng.choice("bdfgklnprstv") + rng.choice("aeou") for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(words) + ".")
        bad.append(i % 6 == 0)
    return texts, np.array(bad)


def test_toxicity_held_out_and_gapped():
    texts, bad = toxic_texts()
    model = toxicity.Model(texts[:400], bad[:400])
    scores = model.scores(texts[400:])
    assert ((scores >= 0.5) == bad[400:]).mean() > 0.98
    gapped = model.scores(["such an id-iot here", "an i d i o t here", "a mor_on here", "wortthless", "a green window"])
    assert (gapped[:4] >= 0.5).all() and gapped[4] < 0.5
    assert model.scores(["", "   "]).max() < 0.5


def test_toxicity_kernel_is_the_sum_over_gapped_trigrams():
    def kernel(a, b):
        def grams(s):
            out = Counter()
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                        out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        x, y = grams(a), grams(b)
        return sum(x[g] * y[g] for g in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    marks = ["`idiot", "`moron"]
    got = toxicity.Kernel(marks).of_strings(["`idixot", "`morons", "`banana"])
    assert np.allclose(got, [[kernel(w, m) for m in marks] for w in ("`idixot", "`morons", "`banana")], atol=1e-5)


def test_toxicity_query(spark, docs, empty):
    texts, bad = toxic_texts(300)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert toxicity.score(empty, model).count() == 0
    one_class = toxicity.train(table, labels.where("toxic = 0"))
    assert toxicity.score(docs, one_class).agg(F.max("score")).first()[0] == 0.0
    all_toxic = toxicity.train(table, labels.where("toxic = 1"))
    assert toxicity.score(docs, all_toxic).agg(F.min("score")).first()[0] == 1.0
    scored = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    assert len(scored) == len(texts)
    want = model.scores(texts)
    for i, (_, own) in enumerate(zip(texts, want, strict=True)):
        r = scored[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["score"] == pytest.approx(own) and r["predicted"] == int(own >= 0.5)
    aside = [i for i in range(len(texts)) if scored[i]["held_out"]]
    assert sum(scored[i]["predicted"] == int(bad[i]) for i in aside) >= 0.95 * len(aside)
    long = spark.createDataFrame([(1, "lo " * 200_000 + "moron"), (2, ""), (3, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("held_out", "score", "predicted")})
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(long, model).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


# 2 token counts


def test_tokens_match_the_library(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["aaaaaaaa" * 40, "<|endoftext|> x <|endoftext|>", " \n\n  x", "it's WE'LL", "日本語 🎉", "a\x00b", "1234 ٣٤", "=" * 200]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = rows_of(tokens.count_tokens(table, path, public.PATTERN), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for r in table.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 512))
    assert got == sorted(want, key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))


# 3 suffix arrays


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(400)) + b"x" * 120 + bytes(rng.choice(b"abc") for _ in range(200))
    words = suffixes.packed(np.frombuffer(text, np.uint8))
    order = suffixes.suffix_array(words, len(text))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:] )
    lcp = suffixes.common_prefixes(words, order, 50)
    for i in range(1, len(order)):
        a, b, k = text[order[i] :], text[order[i - 1] :], 0
        while k < 50 and k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert lcp[i] == k or max(order[i], order[i - 1]) + 50 > len(text)


def removed_by_brute_force(rows):
    first = {}
    for i, t in sorted((i, t or "") for i, t, *_ in rows if i is not None):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 1])
def test_substrings(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_SHARDS", hot)
    got = rows_of(substrings.remove_repeats(docs, 2_000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(removed_by_brute_force(corpus()), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))
    if hot == 1:
        assert substrings.remove_repeats(empty).count() == 0


def test_anchors_of_hot_shards_and_long_texts_agree():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = substrings.anchors([text])
    assert all(len(x) == len(whole[0]) for x in whole)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[2], whole[3])])
    assert covered.tolist() == list(range(len(text) - 49))


# 4 decontamination


def contaminated_by_brute_force(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[p : p + 10])].add(str(i) if i is not None else "")
    sizes = {len(k) for k in windows}
    out = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, empty):
    rows = corpus()
    items = [(1, " ".join(rows[0][1].split()[5:25])), (2, rows[0][1].upper()), (2, " ".join(rows[3][1].split()[:10])), (3, "ünï çödé"), (4, None), (5, "  "), (6, rows[41 - 41 + 4][1]), (7, "no such words anywhere"), (None, " ".join(rows[7][1].split()[-12:]))]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    got = decontaminate.find(docs, table)
    got = got.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("s"), (F.col("n_hit") > 0).alias("c"))
    want = contaminated_by_brute_force(rows, items)
    assert rows_of(got, *got.columns) == sorted(want, key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))
    assert decontaminate.find(empty, table).count() == 0
    assert decontaminate.find(docs, table.where("false")).where("n_hit > 0").isEmpty()


# 5 chat formatting


def test_chat(spark):
    rows = [(1, 0, "user", "How are you?\nFine weather."), (1, 1, "bot", "> How are you?\nVery well, thanks."), (1, 2, "user", ">> how are YOU\n> Very well, thanks!\nGood to hear"), (1, 3, "bot", "no quote here"), (1, 4, "user", "> nobody said this\nok"), (2, 0, "user", None), (2, 1, "bot", "> How are you?"), (None, 0, "user", "> x"), (3, 0, "user", ""), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("up", F.lit(1))
    got = {(r["conv_id"], r["turn"]): r for r in chat.threads(df).collect()}
    assert [(got[1, t]["parent_turn"], got[1, t]["root_turn"], got[1, t]["depth"]) for t in range(5)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0), (None, 4, 0)]
    assert got[1, 2]["text"] == "Good to hear" and got[1, 4]["text"] == "ok" and got[2, 0]["text"] == ""
    assert chat.threads(df).count() == len(rows) and chat.threads(df.where("false")).count() == 0


def quoted_conversations(n=250, seed=12):
    """Conversations whose messages quote others: whole, in part, wrapped anew, nested, or nobody at all."""
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        said = []
        for turn in range(rng.randint(1, 14)):
            own = [prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 3))] + rng.choice([[], ["ok"], ["Thanks!"]])
            text = "\n\n".join(own)
            if said and rng.random() < 0.8:
                quoted = rng.choice(said).split("\n")
                if rng.random() < 0.3:
                    quoted = [" ".join(quoted)]
                if rng.random() < 0.4:  # wrapped anew
                    quoted = [" ".join(w) for line in quoted for w in [line.split()[k : k + 5] for k in range(0, max(1, len(line.split())), 5)]]
                if rng.random() < 0.3 and len(quoted) > 1:
                    quoted = quoted[: len(quoted) // 2]
                text = "\n".join(("> " if not x.startswith(">") else ">") + x for x in quoted) + "\n" + text
            if rng.random() < 0.1:
                text = "> " + prose(rng, 5) + "\n" + text
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "bot"]), text))
    extra = [(None, 3, "user", "> ok"), (7, None, "bot", "ok"), (8, 0, None, None), (8, 1, "user", "> " + "ok " * 30000), (9, 0, "user", ""), (9, 0, "user", "twice")]
    return rows + extra


def test_quoted_conversations_match_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(quoted_conversations(), "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    result = con.execute(chat.ORACLE)
    names = [c[0] for c in result.description]
    want = sorted(repr(dict(zip(names, r, strict=True))) for r in result.fetchall())
    clash = df.withColumns({c: F.lit("x") for c in ("up", "steps", "position", "kind", "level", "hash", "n", "part", "inner", "l")})
    found = chat.threads(clash).select(*names).collect()
    assert sorted(repr(r.asDict()) for r in found) == want
    assert sum(r["parent_turn"] is not None for r in found) > 800 and max(r["depth"] for r in found) >= 5


# 6 top-k


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)]) for i in range(300)] + [(1000 + i, [0.1] * 8) for i in range(60)]
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, []), (None, [0.5] * 8), (40, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = rows_of(topk.search(df), "query_id", "rank", "vec_id", "score")
    kept = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in kept]
    want = []
    for at, (a, v) in enumerate(whole):  # a row that repeats a vec_id is a candidate and a query of its own
        if a % 20 == 0:
            best = sorted((-int(v @ w), b) for k, (b, w) in enumerate(whole) if k != at)[:20]
            want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    assert got == sorted(want)
    assert rows_of(topk.search(df, tile_bytes=64 * 50), "query_id", "rank", "vec_id", "score") == got
    assert topk.search(df.where("false")).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.search(huge).orderBy("rank").collect()] == [1, 2]


# 7 near duplicates


def components_by_brute_force(rows, n=2):
    sets = defaultdict(set)
    sizes = []
    parent = {}
    for i, t, *_ in rows:
        w = spaced(low(t))
        s = frozenset(tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))) if w else frozenset()
        sizes.append((i, len(s)))
        if i is not None:
            parent.setdefault(i, i)
            if s:
                sets[i].add(s)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return [(i, size, top(i) if i is not None else None, i is None or top(i) == i) for i, size in sizes]


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(9)
    rows = corpus()
    base = prose(rng, 200).split()
    for i in range(40):  # a chain of near copies, and stragglers around the threshold
        words = list(base)
        for _ in range(rng.randint(1, 16)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((100 + i, " ".join(words), "s0"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("a", "key", "component")})
    got = rows_of(neardup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(components_by_brute_force(rows), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))
    assert neardup.near_duplicates(empty).count() == 0
    # the same from many tiles of one cluster, of which few members are anchors
    tiled = neardup.near_duplicates(df, tile_bytes=8000, anchors=2)
    assert rows_of(tiled, "doc_id", "n_shingles", "component_id", "kept") == got


def test_a_group_makes_an_edge_a_member(spark):
    rng = random.Random(8)
    # near copies share most keys, two groups meet in one key, others have keys of their own
    rows = [(rng.getrandbits(40), [f"{g}-{band}-{rng.choice([0, 0, 1, 2, i + 3])}" for band in range(42)]) for g in range(3) for i in range(60)]
    rows = [(s1, [zlib.crc32(k.encode()) for k in keys]) for s1, keys in rows]
    rows[0][1][0] = rows[60][1][0]
    near = {s1: s1 for s1, _ in rows}
    by_key = {}
    for _ in range(6):
        for s1, keys in rows:
            for k in keys:
                by_key[k] = near[s1] = min(by_key.get(k, near[s1]), near[s1])
    edges = neardup.stars(spark.createDataFrame(rows, "s1 long, keys array<long>"))
    assert edges.count() < 2 * len(rows)
    got = {r["id"]: r["component"] for r in neardup.components(edges).collect()}
    assert {s1: got.get(s1, s1) for s1 in near} == near and len(set(near.values())) == 2


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.7, 0.8, 0.9):
        common = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        extra = int(1000 * (1 / share - 1) / 2)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, extra, dtype=np.uint64)]) for _ in range(2))
        x, y = neardup.odd_sketches(np.array([neardup.min_hashes(a), neardup.min_hashes(b)]))
        apart = np.unpackbits((x ^ y).view(np.uint8)).sum()
        got = 1 + neardup.SKETCH_BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * apart / neardup.SKETCH_BITS)
        assert abs(got - share) < 0.07


def test_shingles_are_those_of_the_words():
    texts = ["One two  three\tTWO", "one", "", "a b a b a"]
    sets = shingles.shingle_sets([t.encode() for t in texts], 2)
    assert [len(s) for s in sets] == [3, 1, 0, 2]


# 8 mixing


def test_mixing(docs, empty):
    got = mixing.mix(docs.select("doc_id", "text", "source", "size", "at")).collect()
    assert len(got) == docs.count()
    size = Counter()
    for _, t, s in corpus():
        size[s] += len(spaced(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, open_ = {}, sum(size.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(target[r["source"]], abs=1e-5)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 2 for s in order)
    assert mixing.mix(empty.select("doc_id", "text", "source")).count() == 0


def test_slots_have_their_ranks(spark):
    bits = 6
    spread = spark.createDataFrame([("a", 0, 17), ("b", 17, 18), ("c", 18, 64), ("d", 64, 64)], "source string, lo long, hi long")
    got = {(r["source"], r["slot"]): r["rank"] for r in mixing._slots(spread, bits).collect()}
    at = Counter()
    assert len(got) == 64
    for k in range(64):
        j = int(f"{k:06b}"[::-1], 2)
        s = "a" if j < 17 else "b" if j < 18 else "c"
        assert got[s, k] == at[s]
        at[s] += 1


# 9 licences


def test_licenses(spark, docs, empty):
    rng = random.Random(4)
    rows = [(1, prose(rng, 300) + " Released under the MIT License. " + prose(rng, 50)), (2, licenses.TEMPLATES["ISC"].upper()), (3, "released under the mit"), (4, None), (5, ""), (6, " ".join(licenses.TEMPLATES.values())), (7, "Permission to use, copy, modify, and/or distribute this code for any purpose with or without fee is hereby granted")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("span", F.lit(1))
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in licenses.scan(df).collect()}
    assert got[1] == {"MIT"} and got[2] == {"ISC"} and got[3] == set() and got[4] == set() and got[5] == set()
    assert got[6] == set(licenses.TEMPLATES)
    assert got[7] == set()  # a changed word breaks five of its shingles
    assert licenses.scan(empty).count() == 0


def test_usual_licenses_by_lines_of_other_sources(spark):
    from pathlib import Path

    rng = random.Random(6)
    mit = Path(licenses.__file__).parent / "license_texts"
    lines = {
        "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
        "CC-BY-SA-4.0-url": "See https://creativecommons.org/licenses/by-sa/4.0/ for terms.",
        "CC-BY-NC-ND-4.0-name": "This article is distributed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the FSF.",
        "AGPL-notice": "You may copy it under the terms of the GNU Affero General Public License, version 3.",
        "GPL-3.0-text": (mit / "GPL-3.txt").read_text(),
        "Apache-2.0-text": (mit / "Apache-2.0.txt").read_text().replace("\n", " "),
    }
    rows = [(i, prose(rng, 90) + "\n" + text + "\n" + prose(rng, 40)) for i, text in enumerate(lines.values())] + [(50, prose(rng, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in licenses.scan(df).collect()}
    assert all(name in got[i] for i, name in enumerate(lines)) and got[50] == set()
    assert got[0] == {"CC-BY-NC-4.0-short"} and got[1] == {"CC-BY-SA-4.0-url"}
    own = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in licenses.scan(df, {"mine": "for terms"}).collect()}
    assert own[1] == {"mine"} and own[0] == set()


# 10 line deduplication


def lines_by_brute_force(rows):
    first, out = {}, []
    parts = []
    for i, t, *_ in rows:
        if t is None:
            parts.append([])
            continue
        lines, start, chunks, before = t.split("\n"), 0, [], ""
        for k, line in enumerate(lines):
            h = hashlib.md5(line.encode()).hexdigest()
            if hashlib.md5((before + h).encode()).hexdigest()[0] < linededup.BOUNDARY or k == len(lines) - 1:
                chunks.append((start, lines[start : k + 1]))
                start = k + 1
            before = h
        parts.append(chunks)
    places = sorted(((i is None, i if i is not None else 0, s, t), "\n".join(c)) for (i, t, *_), chunks in zip(rows, parts) for s, c in chunks if len(c) >= 2)
    for place, chunk in places:
        first.setdefault(chunk, place)
    for (i, t, *_), chunks in zip(rows, parts):
        kept = [x for s, c in chunks for x in c if len(c) < 2 or first["\n".join(c)] == (i is None, i if i is not None else 0, s, t)]
        n = sum(len(c) for _, c in chunks)
        out.append((i, n, n - len(kept), "\n".join(kept) if t is not None else None))
    return out


def test_line_dedup(spark, empty):
    rng = random.Random(8)
    shared = [prose(rng, 8) for _ in range(12)]
    rows = [(i, "\n".join([prose(rng, 5) for _ in range(rng.randint(0, 6))] + shared + [prose(rng, 5) for _ in range(rng.randint(0, 6))])) for i in range(15)]
    rows += [(20, rows[0][1]), (21, None), (22, ""), (23, "\n\n\n"), (24, "\n\n\n"), (25, "one line"), (None, rows[1][1]), (26, "\n".join(shared * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lines": F.lit(1), "hash": F.lit(2)})
    got = rows_of(linededup.remove_chunks(df), "doc_id", "n_lines", "n_removed", "kept")
    assert got == sorted(lines_by_brute_force(rows), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))
    assert linededup.remove_chunks(empty).count() == 0


def passages_by_brute_force(rows):
    """Every run of two lines or more that an earlier place holds, found by comparing all places."""
    order = sorted((i is None, i if i is not None else 0, t) for i, t in rows if t is not None)
    seen, gone = set(), {}
    for doc in dict.fromkeys(order):
        lines = doc[2].split("\n")
        for s in range(len(lines) - 1):
            if tuple(lines[s : s + 2]) in seen:
                gone.setdefault(doc, set()).update([s, s + 1])
            seen.add(tuple(lines[s : s + 2]))
    out = []
    for i, t in rows:
        out_ = gone.get((i is None, i if i is not None else 0, t), set())
        lines = t.split("\n") if t is not None else []
        out.append((i, len(lines), len(out_), "\n".join(x for k, x in enumerate(lines) if k not in out_) if t is not None else None))
    return out


def test_planted_passages_go_whole(spark, empty):
    rng = random.Random(12)
    own = lambda n: [prose(rng, 6) + f" {rng.random()}" for _ in range(n)]
    planted = {n: own(n) for n in (2, 3, 4, 7, 20)}
    rows = [(0, "\n".join(x for p in planted.values() for x in [*p, *own(1)]))]
    rows += [(i, "\n".join([*own(rng.randint(1, 4)), *planted[n], *own(rng.randint(1, 4))])) for i, n in enumerate([2, 3, 4, 7, 20] * 6, 1)]
    rows += [(100, "\n".join(planted[20][:9] + planted[7][2:5])), (101, "\n".join(planted[20][3:12])), (102, rows[0][1]), (103, None), (104, ""), (105, "\n\n\n"), (106, "\n\n\n"), (107, planted[4][0]), (None, rows[1][1]), (108, "a\na\na"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lines": F.lit(1), "hash": F.lit(2)})
    got = rows_of(linededup.remove_passages(df), "doc_id", "n_lines", "n_removed", "kept")
    assert got == sorted(passages_by_brute_force(rows), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))
    stage = {r["doc_id"]: r["text"] for r in linededup.linededup_stage(spark, df, "").collect()}
    assert all(not set(planted[n]) & set(stage[i].split("\n")) for i, n in enumerate([2, 3, 4, 7, 20] * 6, 1))
    assert linededup.remove_passages(empty).count() == 0
