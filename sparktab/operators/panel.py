"""Panels: structure and baseline forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import q


def daily(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """entity, day, n, total: one row for each entity and day that has rows."""
    return df.groupBy(q(entity).alias("entity"), F.date_trunc("day", q(time)).cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(q(value)).alias("total"))


def panel_structure(df: DataFrame, entity: str, time: str) -> DataFrame:
    """entity, n, first, last, gaps (steps of more than a day), max_gap_days over distinct days."""
    days = df.select(q(entity).alias("entity"), F.to_date(q(time)).alias("d")).distinct()
    w = Window.partitionBy("entity").orderBy("d")
    gap = F.datediff("d", F.lag("d").over(w))
    per = days.withColumn("g", gap).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.count_if(F.col("g") > 1).alias("gaps"), F.coalesce(F.max("g"), F.lit(0)).alias("max_gap_days"))
    return per


def panel_summary(df: DataFrame, entity: str, time: str) -> DataFrame:
    """n_series, min_n, median_n, max_n, with_gaps."""
    return panel_structure(df, entity, time).agg(F.count(F.lit(1)).alias("n_series"), F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"), F.count_if(F.col("gaps") > 0).alias("with_gaps"))


def naive_forecasts(df: DataFrame, entity: str, time: str, key: str, value: str, season: int, moving: int) -> DataFrame:
    """df with last_value, seasonal_naive, drift and moving_average, each from earlier rows of the entity only."""
    w = Window.partitionBy(q(entity)).orderBy(q(time), q(key))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(w) - 1
    last, first = F.lag(q(value), 1).over(w), F.first(q(value)).over(past)
    drift = F.when(n >= 2, last + (last - first) / (n - 1))
    return df.withColumns({"last_value": last, "seasonal_naive": F.lag(q(value), season).over(w), "drift": drift, "moving_average": F.avg(q(value)).over(w.rowsBetween(-moving, -1))})
