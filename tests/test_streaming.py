"""Streams give the windows that the same functions give on batches."""

from pyspark.sql import functions as F

from sparktab.streaming import labels as delayed
from sparktab.streaming import monitor

DATA = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = monitor.write_each(monitor.windowed_counts(stream, "ts", ["event_type"], "value", "1 day"), str(tmp_path / "out"), str(tmp_path / "log"))
    query.awaitTermination(60)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in monitor.windowed_counts(events, "ts", ["event_type"], "value", "1 day").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    assert len(want) - len(got) <= 10  # the watermark holds the last windows back
    assert monitor.drift_alerts(monitor.windowed_counts(events, "ts", [], "value", "1 day"), 1e6, 1.0).count() > 0


def _scores_and_labels(spark, n=200):
    at = "timestamp_seconds(1704067200 + {0} * 600)"
    scores = spark.range(n).selectExpr("id AS k", at.format("id") + " AS t", "id % 7 / 7.0D AS s")
    # every third has no label, every tenth one that comes too late
    hours = "CASE WHEN id % 10 = 0 THEN 30 ELSE 1 + id % 5 END"
    labels = spark.range(n).where("id % 3 > 0").selectExpr("id AS k", f"timestamp_seconds(1704067200 + id * 600 + 3600 * ({hours})) AS lt", "CAST(id % 2 AS INT) AS y")
    return scores, labels


def test_delayed_labels_of_shuffled_files_equal_the_batch(spark, tmp_path):
    scores, labels = _scores_and_labels(spark)
    want = {r["k"]: (r["status"], r["y"]) for r in delayed.delayed_labels(scores, labels, "k", "t", "lt", "6 hours").collect()}
    assert {v[0] for v in want.values()} == {"matured", "lost"}
    for name, df in (("s", scores), ("l", labels)):
        df.union(df.limit(20)).repartition(3).write.parquet(str(tmp_path / name))  # 20 rows come twice
        last = {"s": "SELECT CAST(-1 AS BIGINT) k, TIMESTAMP '2030-01-01' t, 0.0D s", "l": "SELECT CAST(-1 AS BIGINT) k, TIMESTAMP '2030-01-01' lt, 0 y"}[name]
        spark.sql(last).write.parquet(str(tmp_path / f"{name}2"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))

    def run():
        rows = delayed.delayed_labels(read("s", scores), read("l", labels), "k", "t", "lt", "6 hours", "40 hours")
        query = delayed.write_batches(rows, str(tmp_path / "out"), str(tmp_path / "log"))
        assert query.awaitTermination(120)
        return query

    assert delayed.late_rows(run()) == 0
    # the watermark passes all rows with the last file, and a row behind it is counted as late
    for name in "sl":
        spark.read.parquet(str(tmp_path / f"{name}2")).write.mode("append").parquet(str(tmp_path / name))
    run()
    scores.where("k = 5").withColumn("k", F.col("k") + 10_000).write.mode("append").parquet(str(tmp_path / "s"))
    assert delayed.late_rows(run()) >= 1
    got = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["k"] >= 0]
    assert len(got) == len({r["k"] for r in got})
    assert {r["k"]: (r["status"], r["y"]) for r in got} == want
