"""Exact ranks and quantiles of whole columns without a task that orders, or holds, a whole column.

Quantiles come in two steps: approximate ones, whose sketches merge map-side, bracket each exact one between two values
with few rows between them; then the rows below are counted and only the bracket's values are ordered.
Running sums over ordered values go by ranges of about as many distinct values, then over the ranges' totals.
"""

from __future__ import annotations

import functools
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the approximate quantiles: ranks are off by a 1 / ACCURACY of the rows at most. Up to FEW rows nothing is bracketed.
ACCURACY, FEW = 10_000, 10_000
_SLACK = 2 / ACCURACY


def brackets(p: float) -> list[float]:
    """Approximate quantiles between which the exact one lies."""
    return [max(0.0, p - _SLACK), min(1.0, p + _SLACK)]


def quantiles(df: DataFrame, columns: dict[str, Column], at: list[float]) -> dict[str, list[float | None]]:
    """The exact quantiles (linear interpolation) of each expression, a double whose nulls don't count."""
    return quantiles_with(df, columns, at, [])[0]


def quantiles_with(df: DataFrame, columns: dict[str, Column], at: list[float], others: list[Column]) -> tuple[dict[str, list[float | None]], Row]:
    """quantiles, and a row of other aggregates that are taken in the first of its passes.

    The first pass sketches, the second counts values below and within each bracket, and the third, where a bracket isn't a
    single value, orders the values within it; rows outside all brackets are dropped before anything is made of them.
    """
    sketched = [p for q in at for p in brackets(q)]
    names = list(columns)
    aggs = []
    for i, name in enumerate(names):
        x = columns[name]
        sketch = F.percentile_approx(x, sketched, ACCURACY)
        aggs.append(F.struct(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), sketch.alias("p")).alias(f"_c{i}"))
    first = df.agg(*aggs, *others).first()
    # (column, quantile) to its bracket
    held: dict[tuple[int, int], tuple[float, float]] = {}
    for i in range(len(names)):
        s = first[f"_c{i}"]
        for k, p in enumerate(at if s["n"] else []):
            low, high = s["p"][2 * k], s["p"][2 * k + 1]
            held[i, k] = (s["lo"] if s["n"] <= FEW or p <= _SLACK else low, s["hi"] if s["n"] <= FEW or p >= 1 - _SLACK else high)
    out: dict[str, list[float | None]] = {name: [None] * len(at) for name in names}
    if not held:
        return out, first
    counts = [c for (i, k), (lo, hi) in held.items() for c in (F.count_if(columns[names[i]] < F.lit(lo)).alias(f"b{i}_{k}"), F.count_if(columns[names[i]].between(lo, hi)).alias(f"w{i}_{k}"))]
    near = df.agg(*counts).first()
    rank = {(i, k): at[k] * (first[f"_c{i}"]["n"] - 1) for i, k in held}
    wide = {}
    for (i, k), (lo, hi) in held.items():
        if lo == hi and near[f"b{i}_{k}"] <= math.floor(rank[i, k]) and math.ceil(rank[i, k]) < near[f"b{i}_{k}"] + near[f"w{i}_{k}"]:
            out[names[i]][k] = lo
        else:
            wide[i, k] = lo, hi
    if not wide:
        return out, first
    within = {ik: columns[names[ik[0]]].between(*bracket) for ik, bracket in wide.items()}
    cells = F.array(*[F.when(w, F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), columns[names[i]].alias("v"))) for (i, k), w in within.items()])
    rows = df.where(functools.reduce(Column.__or__, within.values())).select(F.explode(F.array_compact(cells)).alias("x")).select("x.*").groupBy("i", "k", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i", "k").orderBy("v"))
    wanted = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(near[f"b{i}_{k}"]).alias("below"), F.lit(rank[i, k]).alias("r")) for i, k in wide]
    ranks = df.sparkSession.range(1).select(F.explode(F.array(*wanted)).alias("w")).select("w.*")
    placed = rows.withColumn("upto", upto).join(F.broadcast(ranks), ["i", "k"])
    placed = placed.withColumns({"first": F.col("below") + F.col("upto") - F.col("n"), "last": F.col("below") + F.col("upto") - 1})
    found = placed.where((F.col("last") >= F.floor("r")) & (F.col("first") <= F.ceil("r")))
    ends = found.groupBy("i", "k", "r").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min_by("last", "v").alias("last"))
    for x in ends.collect():  # one row for each column and quantile
        low, part = math.floor(x["r"]), x["r"] - math.floor(x["r"])
        high = x["lo"] if x["last"] >= low + (part > 0) else x["hi"]
        out[names[x["i"]]][x["k"]] = x["lo"] + (high - x["lo"]) * part
    return out, first


def grouped_median(df: DataFrame, key: str, value: str, p: float = 0.5) -> DataFrame:
    """key, n, median: the exact quantile of value (a double) in each group, null keys and values left out.

    A group's values are sketched map-side; of a large group only the bracket's values are ordered in one task.
    """
    df = df.select(F.col(key).alias("g"), F.col(value).alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    sketch = F.percentile_approx("v", brackets(p), ACCURACY)
    per = df.groupBy("g").agg(F.count("*").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi"), sketch.alias("s"))
    few = F.col("all") <= FEW
    per = per.select("g", "all", F.when(few, F.col("lo")).otherwise(F.col("s")[0]).alias("lo"), F.when(few, F.col("hi")).otherwise(F.col("s")[1]).alias("hi"))
    # values below the bracket stand as one row for each task and group
    cell = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    cells = df.join(per, "g").where("v <= hi").groupBy("g", "all", cell.alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("g").orderBy(F.col("v").asc_nulls_first())
    r = F.lit(p) * (F.col("all") - 1)
    cells = cells.withColumn("last", F.sum("n").over(w) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    near = cells.where((F.col("last") >= F.floor(r)) & (F.col("first") <= F.ceil(r)))
    ends = near.groupBy("g", "all").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("last").alias("last"))
    part = r - F.floor(r)
    high = F.when(F.col("last") >= F.ceil(r), F.col("lo")).otherwise(F.col("hi"))
    return ends.select(F.col("g").alias(key), F.col("all").alias("n"), (F.col("lo") + (high - F.col("lo")) * part).alias("median"))


def as_double(c: Column, kind: T.DataType) -> Column:
    """A double in the order of a number, date or time."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def ranged(df: DataFrame, value: str, out: str, ranges: int) -> DataFrame:
    """df with the number of the range that value (a double, not null) falls in; ranges hold about as many rows each."""
    cuts = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 4 * ranges)).first()[0] or []
    inner = sorted({float(x) for x in cuts if x is not None and math.isfinite(x)})
    splits = [-math.inf, *inner, math.inf]
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df).withColumn(out, F.col(out).cast("int"))


def running_sums(per: DataFrame, value: str, sums: dict[str, str], ranges: int = 256, descending: bool = False) -> DataFrame:
    """per with, for each column of sums, its sum over all smaller values (or larger ones); values are distinct doubles."""
    cut = ranged(per, value, "_range", ranges)
    order = lambda c: F.desc(c) if descending else F.asc(c)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner, outer = before(Window.partitionBy("_range").orderBy(order(value))), before(Window.orderBy(order("_range")))
    totals = cut.groupBy("_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])  # as few rows as ranges
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(outer), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))])
    placed = cut.withColumns({f"_i{i}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for i, c in enumerate(sums)})
    placed = placed.join(F.broadcast(totals), "_range")
    out = [(F.col(f"_i{i}") + F.col(f"_o{i}")).alias(name) for i, name in enumerate(sums.values())]
    return placed.select(*per.columns, *out)
