"""Distributions: histograms, top labels, time buckets, hash-ordered samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_timestamp, finite, normal_label
from .profile import q

MAX_BUCKETS, MAX_BINS, MIN_BINS = 36, 18, 4


def bins_for(n: int) -> int:
    return min(MAX_BINS, max(MIN_BINS, math.isqrt(n)))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """bin (from 1), bin_start, bin_end, n: equal widths over finite values, the last bin closed, empty bins kept.

    One value makes one bin of half a unit to each side. The range is collected first (three numbers) and the bins are
    then plain arithmetic on each row.
    """
    spark = df.sparkSession
    x = finite(q(column))
    n, lo, hi = df.agg(F.count(x), F.min(x), F.max(x)).first()
    empty = "bin int, bin_start double, bin_end double, n long"
    if not n:
        return spark.createDataFrame([], empty)
    bins = bins_for(n)
    if lo == hi:
        return spark.createDataFrame([(1, lo - 0.5, hi + 0.5, n)], empty)
    width = (hi - lo) / bins
    counted = df.select(F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counted, "bin", "left")
    return out.select("bin", (F.lit(lo) + (F.col("bin") - 1) * width).alias("bin_start"), F.when(F.col("bin") == bins, F.lit(hi)).otherwise(F.lit(lo) + F.col("bin") * width).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n"))


def top_labels(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """label, n of the most frequent normalised labels; ties by label."""
    return df.groupBy(normal_label(q(column)).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(top)


def grain_for(first, last) -> str:
    days = (last - first).days
    return "year" if days > 730 else "month" if days > 90 else "day"


def time_buckets(df: DataFrame, column: str, most: int = MAX_BUCKETS) -> DataFrame:
    """bucket (from 1), period (the bucket's first), n: rows per year, month or day by the span; beyond most, merged."""
    t = as_timestamp(q(column), df.schema[column].dataType)
    first, last = df.agg(F.min(t), F.max(t)).first()
    if first is None:
        return df.sparkSession.createDataFrame([], "bucket int, period timestamp_ntz, n long")
    period = F.date_trunc(grain_for(first, last), t).cast("timestamp_ntz")
    counted = df.where(t.isNotNull()).groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    # observed periods are few: a span of days, months or years
    order = Window.orderBy("period")
    total = F.count(F.lit(1)).over(Window.partitionBy())
    placed = counted.withColumn("bucket", F.when(total > most, F.ntile(most).over(order)).otherwise(F.row_number().over(order)))
    return placed.groupBy("bucket").agg(F.min("period").alias("period"), F.sum("n").alias("n"))


def hash_key(seed: int | str, *columns: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]).cast("binary"))


def hash_sample(df: DataFrame, n: int, key: list[str], seed: int = 7) -> DataFrame:
    """n rows without replacement, the same for the same seed: the smallest md5 of seed and key."""
    order = hash_key(seed, *map(q, key))
    return df.orderBy(order, *map(q, key)).limit(n)


def target_view(df: DataFrame, target: str, numeric: bool, distinct: int) -> DataFrame:
    """label, n: classes of a target of up to 20 values, a histogram of a numeric one, else its top 20."""
    if distinct > 20 and numeric:
        return histogram(df, target).select(F.format_string("%.6g to %.6g", "bin_start", "bin_end").alias("label"), "n")
    return top_labels(df, target, 20)
