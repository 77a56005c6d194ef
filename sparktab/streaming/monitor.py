"""Windowed monitors over event streams; the same functions serve batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str, keys: list[str], value: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, keys, n, missing, mean, low, high of a value; rows later than the watermark are left out."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    per = F.window(time, window, slide) if slide else F.window(time, window)
    x = F.col(value)
    got = timed.groupBy(per.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "missing", "mean", "low", "high")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, key, n of each session, closed by a gap."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    got = timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def drift_alerts(counts: DataFrame, expected_mean: float, expected_std: float, limit: float = 3.0) -> DataFrame:
    """Windows whose mean lies beyond limit standard errors of the expected one."""
    z = (F.col("mean") - F.lit(expected_mean)) / (F.lit(expected_std) / F.sqrt("n"))
    return counts.withColumn("z", z).where(F.abs("z") > F.lit(limit))


def write_each(counts: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Append finished windows to Parquet; exactly once through the file sink's log."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start(path)
