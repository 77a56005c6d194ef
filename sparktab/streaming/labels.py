"""Labels that come after the scores they judge: a stateful join of two streams; the same function serves batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def delayed_labels(scores: DataFrame, labels: DataFrame, key: str, score_time: str, label_time: str, horizon: str, late: str = "10 minutes") -> DataFrame:
    """scores with label columns and status: 'matured' where a label of the key came within horizon of the score, else 'lost'.

    On streams both sides have watermarks, so state older than horizon and late is let go and an unlabelled score comes out as
    lost once no label can come any more; rows of one key that are delivered twice within the watermark count once. Labels
    before their score, and null keys, match nothing; a batch keeps the earliest of each key's rows.
    """
    names = {c: f"_{c}" for c in labels.columns}
    right = labels.withColumnsRenamed(names)
    lk, lt = names[key], names[label_time]

    def once(df: DataFrame, k: str, t: str) -> DataFrame:
        if df.isStreaming:
            return df.withWatermark(t, late).dropDuplicatesWithinWatermark([k])
        rows = df.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(F.struct(t, *[c for c in df.columns if c not in (k, t)])).alias("_r"))
        return rows.select(k, "_r.*").select(*df.columns).unionByName(df.where(F.col(k).isNull()))

    a, b = once(scores, key, score_time), once(right, lk, lt)
    on = (F.col(key) == F.col(lk)) & (F.col(lt) >= F.col(score_time)) & (F.col(lt) <= F.col(score_time) + F.expr(f"INTERVAL {horizon}"))
    joined = a.join(b, on, "left_outer")
    kept = [F.col(names[c]).alias(c if c not in scores.columns else f"label_{c}") for c in labels.columns if c != key]
    return joined.select(*scores.columns, *kept, F.when(F.col(lk).isNotNull(), "matured").otherwise("lost").alias("status"))


def write_batches(rows: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Each micro-batch into its own folder, which a repeated batch overwrites: what is written doesn't depend on retries."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    writer = rows.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress that the query still holds."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
