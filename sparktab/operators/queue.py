"""Review queues of limited capacity and their stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import q
from .ranks import quantiles, running_sums

#: Hash parts of a batch that are ranked apart.
PARTS = 64


def select_queue(df: DataFrame, batch: str, entity: str, score: str, key: str, capacity: int, per_entity: int) -> DataFrame:
    """The rows of each batch's queue with queue_rank: at most per_entity rows an entity, then the best scores; ties by key.

    Rows beyond the entity cap or the capacity can't be in the queue: that cap is what a queue is.
    """
    order = [F.desc(q(score)), q(key)]
    capped = df.where(q(score).isNotNull()).withColumn("_e", F.row_number().over(Window.partitionBy(q(batch), q(entity)).orderBy(*order))).where(F.col("_e") <= per_entity)
    return capped.withColumn("queue_rank", F.row_number().over(Window.partitionBy(q(batch)).orderBy(*order))).where(F.col("queue_rank") <= capacity).drop("_e")


def capacity_metrics(df: DataFrame, batch: str, label: str, score: str, key: str, k: int) -> DataFrame:
    """batch, n, positives, hits, precision, recall, lift of each batch's k best rows.

    The k best of PARTS hash parts of a batch hold the k best of the batch, so that no task ranks a whole batch.
    """
    y = (q(label) == 1).cast("long")
    rows = df.select(q(batch).alias("batch"), y.alias("y"), q(score).alias("s"), q(key).alias("k"))
    order = [F.desc("s"), "k"]
    part = F.pmod(F.xxhash64("k"), F.lit(PARTS))
    best = rows.withColumn("_r", F.row_number().over(Window.partitionBy("batch", part).orderBy(*order))).where(F.col("_r") <= k)
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("batch").orderBy(*order))).where(F.col("_r") <= k)
    hits = best.groupBy(F.col("batch").alias("b")).agg(F.sum("y").alias("hits"))
    per = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    per = per.join(hits, F.col("batch").eqNullSafe(F.col("b"))).drop("b")
    precision = F.col("hits") / F.least(F.lit(k), F.col("n")).cast("double")
    return per.select("batch", "n", "positives", "hits", precision.alias("precision"), F.try_divide(F.col("hits").cast("double"), "positives").alias("recall"), F.try_divide(precision, F.col("positives") / F.col("n")).alias("lift"))


def rank_overlap(a: DataFrame, b: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """k, n_common, overlap of two scorings' k best keys."""
    best = lambda df: df.orderBy(F.desc(q(score)), q(key)).limit(k).select(q(key))
    return best(a).join(best(b), key).agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n_common"), (F.count(F.lit(1)) / F.lit(k)).alias("overlap"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, spearman: Pearson's correlation of mean ranks, ranks taken over the distinct values' counts."""
    def ranks(c: str, name: str) -> DataFrame:
        per = df.where(q(c).isNotNull()).groupBy(q(c).cast("double").alias(f"_{name}")).agg(F.count(F.lit(1)).alias("n"))
        per = running_sums(per, f"_{name}", {"n": "below"})
        return per.select(f"_{name}", (F.col("below") + (F.col("n") + 1) / 2.0).alias(name))

    both = df.join(ranks(x, "rx"), q(x).cast("double") == F.col("_rx"))
    both = both.join(ranks(y, "ry"), q(y).cast("double") == F.col("_ry"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("spearman"))


def concentration(df: DataFrame, entity: str) -> DataFrame:
    """n_entities, largest_share, hhi of rows over entities."""
    per = df.groupBy(q(entity)).agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return per.agg(F.count(F.lit(1)).alias("n_entities"), (F.max("n") / n).alias("largest_share"), (F.sum(F.col("n").cast("double") * F.col("n")) / (n.cast("double") * n)).alias("hhi"))


def robust_zscore(df: DataFrame, column: str, out: str = "robust_z") -> DataFrame:
    """df with (x - median) / (1.4826 * MAD); null where the MAD is 0. Two passes collect two numbers."""
    x = q(column).cast("double")
    middle = quantiles(df, {"x": x}, [0.5])["x"][0]
    if middle is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    mad = quantiles(df, {"x": F.abs(x - F.lit(middle))}, [0.5])["x"][0]
    return df.withColumn(out, (x - F.lit(middle)) / F.lit(1.4826 * mad) if mad else F.lit(None).cast("double"))


def maturity_counts(df: DataFrame, vintage: str, scored: str, outcome: str, due: str, now: str) -> DataFrame:
    """vintage, scored, matured, pending, lost: outcomes known, not yet due, and due without one."""
    late = q(due).cast("timestamp_ntz") <= F.lit(now).cast("timestamp_ntz")
    return df.groupBy(q(vintage).alias("vintage")).agg(F.count(q(scored)).alias("scored"), F.count(q(outcome)).alias("matured"), F.count_if(q(outcome).isNull() & ~late).alias("pending"), F.count_if(q(outcome).isNull() & late).alias("lost"))
