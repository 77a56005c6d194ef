"""What op3's shards send: parcels of several content shards, with the rows of brute force."""

import random

import pytest
from test_operators import corpus, removed_by_brute_force, rows_of

from sparktab.llm import substrings

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize(("most", "hot"), [(1, 1024), (3, 1024), (7, 1)])
def test_content_shards_of_a_parcel_stay_apart(spark, monkeypatch, most, hot):
    monkeypatch.setattr(substrings, "PARCELS", most)
    monkeypatch.setattr(substrings, "SHARDS_A_PARCEL", 1000)
    monkeypatch.setattr(substrings, "HOT_SHARDS", hot)
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string, source string")
    got = rows_of(substrings.remove_repeats(docs, 2_000), *COLUMNS)
    assert got == sorted(removed_by_brute_force(corpus(5)), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))


def test_shards_do_not_send_as_many_parcels_as_there_are_content_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "PARCELS", 8, raising=False)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    passages = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(400)]
    spark.createDataFrame([(i, " ".join(rng.choice(passages) for _ in range(30))) for i in range(160)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    context = spark.sparkContext
    store, new = context._jsc.sc().statusStore(), context._gateway.new_array

    def sent():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, new(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    one = rows_of(substrings.remove_repeats(docs, 1 << 30), *COLUMNS)
    before = sent()
    assert rows_of(substrings.remove_repeats(docs, 12_000), *COLUMNS) == one and sum(r[2] for r in one) > 100_000
    assert sent() - before < 6_000


def test_parcels_grow_slower_than_content_shards():
    # at 6 GB 1,500 shards each had 12,000 of them
    assert substrings.parcels(25) == 200 and substrings.parcels(1500) == 1024 and substrings.parcels(7500) == 1875
