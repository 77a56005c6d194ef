"""Exponential smoothing and intermittent demand of many series, long ones in pieces.

A step of smoothing is an affine map of the level, s -> (1 - a) s + a y, and maps compose, so a series is cut into pieces of
PIECE steps: a piece's map is two sums, pieces' maps are folded in order, and each row starts from its piece's level. A whole
grid of constants goes through the same passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .profile import q

#: Steps of a piece; (1 - a) ** -PIECE must stay within a double.
PIECE = 64


def numbered(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df, written once, with _at: each row's place from 0 within its series. One sort over all rows; no task holds a series."""
    keys = [q(by), *[q(c) for c in order]]
    ordered = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_row", 33))
    pieces = ordered.groupBy(q(by).alias("_by"), F.col("_part").alias("_p")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_by", "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ordered.join(pieces, q(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn("_at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_by", "_p", "_first", "_before")


def smoothed(df: DataFrame, by: str, order: list[str], value: str, constants: list[float]) -> DataFrame:
    """series, at, y, alpha, forecast, level: for each constant and row, the level before it (null at a series' first row) and
    after it. Levels begin with the first value; rows without a series or a value are left out."""
    if not all(0 < a < 1 for a in constants):
        raise ValueError("smoothing constants lie between 0 and 1")
    rows = numbered(df.select(q(by).alias("series"), *[q(c).alias(f"o{i}") for i, c in enumerate(order)], q(value).cast("double").alias("y")).where("series IS NOT NULL AND y IS NOT NULL"), "series", [f"o{i}" for i in range(len(order))])
    rows = rows.select("series", F.col("_at").alias("at"), "y", F.explode(F.array(*map(F.lit, constants))).alias("alpha"))
    rows = rows.withColumns({"piece": F.floor(F.col("at") / PIECE).cast("long"), "i": (F.col("at") % PIECE).cast("double")})
    # a first value is the level itself: its weight is 1
    weight = F.when(F.col("at") == 0, F.lit(1.0)).otherwise(F.col("alpha"))
    keep = 1 - F.col("alpha")
    inside = Window.partitionBy("series", "alpha", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("own", F.pow(keep, F.col("i")) * F.sum(weight * F.col("y") * F.pow(keep, -F.col("i"))).over(inside))
    maps = rows.groupBy("series", "alpha", "piece").agg(F.max_by("own", "at").alias("c"))
    # a piece's starting level: the maps before it, in order; one short row a piece
    folded = Window.partitionBy("series", "alpha").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # all pieces before one are full, so their maps share one factor
    full = F.pow(1 - F.col("alpha"), F.lit(float(PIECE)))
    starts = maps.withColumn("start", F.aggregate(F.collect_list("c").over(folded), F.lit(0.0), lambda s, c: s * full + c)).select("series", "alpha", "piece", "start")
    out = rows.join(starts, ["series", "alpha", "piece"])
    level = F.col("own") + F.pow(keep, F.col("i") + 1) * F.col("start")
    out = out.withColumn("level", level)
    before = Window.partitionBy("series", "alpha", "piece").orderBy("at")
    forecast = F.when(F.col("at") > 0, F.coalesce(F.lag("level").over(before), F.col("start")))
    return out.select("series", "at", "y", "alpha", forecast.alias("forecast"), "level")


def best_constants(df: DataFrame, by: str, order: list[str], value: str, constants: list[float]) -> DataFrame:
    """series, n, alpha, mse, level: the constant of least squared one-step error of each series, ties to the smaller, and the
    level after its last row; a series of one row has its value and no error."""
    rows = smoothed(df, by, order, value, constants)
    per = rows.groupBy("series", "alpha").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("y") - F.col("forecast"), F.lit(2.0))).alias("mse"), F.max_by("level", "at").alias("level"))
    key = F.struct(F.coalesce(F.round("mse", 9), F.lit(0.0)).alias("e"), F.col("alpha"))
    return per.groupBy("series").agg(F.min_by(F.struct("n", "alpha", "mse", "level"), key).alias("b")).select("series", "b.*")


def croston(df: DataFrame, by: str, order: list[str], value: str, alpha: float = 0.1, debiased: bool = False) -> DataFrame:
    """series, n, n_demands, size, gap, forecast: smoothed demand over smoothed gap between demands, both by the same constant.

    Only rows of a demand (value not 0) move the two states, which are smoothed as series of their own; the first gap counts
    from the series' start. debiased takes off alpha / 2 of the forecast.
    """
    rows = df.select(q(by).alias("series"), *[q(c).alias(f"o{i}") for i, c in enumerate(order)], q(value).cast("double").alias("y")).where("series IS NOT NULL AND y IS NOT NULL")
    placed = numbered(rows, "series", [f"o{i}" for i in range(len(order))])
    total = placed.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    demands = staged(numbered(placed.where("y <> 0").withColumnRenamed("_at", "t"), "series", ["t"]))
    # each demand meets the one before it by its number
    previous = demands.select("series", (F.col("_at") + 1).alias("_at"), F.col("t").alias("before"))
    gaps = demands.join(previous, ["series", "_at"], "left").select("series", "t", "y", (F.col("t") - F.coalesce("before", F.lit(-1))).cast("double").alias("gap"))
    last = lambda c: smoothed(gaps, "series", ["t"], c, [alpha]).groupBy("series").agg(F.count(F.lit(1)).alias("n_demands"), F.max_by("level", "at").alias(c))
    both = last("y").join(last("gap").drop("n_demands"), "series")
    forecast = F.try_divide("y", "gap") * F.lit(1 - alpha / 2 if debiased else 1.0)
    out = total.join(both.select("series", "n_demands", F.col("y").alias("size"), "gap", forecast.alias("forecast")), "series", "left")
    return out.withColumns({"n_demands": F.coalesce("n_demands", F.lit(0)), "forecast": F.coalesce("forecast", F.lit(0.0))})
