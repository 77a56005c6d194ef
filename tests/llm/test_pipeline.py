"""The pipeline's stages on the smallest tables, and on empty and odd ones."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from sparktab.llm.common import documents, materialise

    docs = documents(spark, DATA).withColumns({"_gone_id": F.lit(1), "_toxic_score": F.lit(2.0), "mix_taken": F.lit(3)})
    start = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        new = materialise(stage(spark, docs, DATA))
        assert new.columns[: len(docs.columns)] == docs.columns
        assert 0 < new.count() <= docs.count()
        if name != "mixing":
            assert new.columns == docs.columns
        docs = new
    assert docs.count() < start
    over = docs.where(F.col(docs.columns[-3]) > 3 * F.size(F.array_remove(F.split("text", "[ \t\n\x0b\f\r]+"), "")))
    assert over.isEmpty()
    assert re.match("mix_taken_", docs.columns[-3])


def test_empty_tables(spark):
    from sparktab.llm.common import documents

    docs = documents(spark, DATA).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_run_matches_brute_force(spark, tmp_path):
    """run() against plain Python for stages 2 to 4, the trained model on single texts for 1, and the mix's promises for 5."""
    import random

    from test_operators import components_by_brute_force, contaminated_by_brute_force, passages_by_brute_force, prose, spaced, toxic_texts

    from sparktab.llm import toxicity

    rng = random.Random(21)
    texts, bad = toxic_texts(300)
    rows = [(i, t) for i, t in enumerate(texts)]
    items = [(i, prose(rng, 14)) for i in range(5)] + [(9, "only five words in here"), (10, None)]
    passage = "\n".join(prose(rng, 12) for _ in range(4))
    for i in range(300, 360):
        base = prose(rng, 60)
        rows.append((i, base + "\n" + passage + "\n" + prose(rng, 40)) if i % 3 == 0 else (i, base))
        if i % 4 == 0:
            rows.append((i + 1000, base + " and more" if i % 3 else base))
        if i % 10 == 0:
            rows.append((i + 2000, prose(rng, 20) + " " + items[i // 10 % 5][1].upper() + " " + prose(rng, 8)))
    rows += [(5000, None), (5001, ""), (5002, "one two three four five six")]
    table = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, int(b)) for i, b in enumerate(bad)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs, known = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    scores = toxicity.train(docs.select("doc_id", "text"), known).scores([t or "" for _, t in rows])
    kept = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    assert {i for i, t in rows if i < 300 and not bad[i]} <= {i for i, _ in kept} and len(kept) < len(rows)
    kept = [(i, t) for i, _, _, t in passages_by_brute_force(kept)]
    alone = {r[0] for r in components_by_brute_force(kept, 5) if r[3]}
    kept = [(i, t) for i, t in kept if i in alone]
    hit = {r[0] for r in contaminated_by_brute_force(kept, items) if r[5]}
    kept = {i: t for i, t in kept if i not in hit}
    assert hit and set(got) <= set(kept)
    source = {i: s for i, _, _, s, _ in table}
    sizes = {}
    for i, t in kept.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(spaced(t))
    taken = dict.fromkeys(sizes, 0)
    for i, r in got.items():
        assert r["text"] == kept[i] and 0 < r["mix_taken"] <= 3 * len(spaced(kept[i]))
        taken[source[i]] += r["mix_taken"]
    target = {source[i]: r["mix_target"] for i, r in got.items()}
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s, words in taken.items():
        assert abs(words - target[s]) <= 2
