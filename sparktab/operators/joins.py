"""Join audits and time-aware joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import q
from .ranks import as_double, ranged

#: Ranges of time that an as-of join works in.
RANGES = 64


def join_integrity(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left_rows, right_rows, right_duplicate_keys, orphans (left rows without a match), matched_rows (after the join).

    Both sides are counted by key first, so the join has one row per key however hot one is.
    """
    a = left.groupBy(q(left_key).alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(q(right_key).alias("k")).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, "k", "full")  # null keys never match, as in the join itself
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.agg(
        zero(F.sum("a")).alias("left_rows"), zero(F.sum("b")).alias("right_rows"), F.count_if((F.col("b") > 1) & F.col("k").isNotNull()).alias("right_duplicate_keys"),
        zero(F.sum(F.when(F.col("b").isNull(), F.col("a")))).alias("orphans"), zero(F.sum(F.col("a") * F.col("b"))).alias("matched_rows"),
    )


def isolation_violations(context: DataFrame, query: DataFrame, keys: list[str]) -> DataFrame:
    """Query rows whose keys (null-safe) also occur in the context; none is right."""
    seen = context.select(*[q(k).alias(f"c{i}") for i, k in enumerate(keys)]).distinct()
    on = [q(k).eqNullSafe(F.col(f"c{i}")) for i, k in enumerate(keys)]
    return query.join(seen, on, "left_semi")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, out: str, strict: bool = False) -> DataFrame:
    """left with the latest value of right at or before (strict: before) its time, for the same key.

    One union and one window over (key, time) instead of a range join: no pair of rows is made. Windows stay within RANGES
    ranges of time; each range's last value of a key is carried to the later ones, so a hot key fills no single task.
    """
    l = left.select("*", q(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    r = right.select(q(by).alias(by), q(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), q(value).alias("_v"), F.lit(True).alias("_right"))
    both = l.withColumn("_right", F.lit(False)).unionByName(r, allowMissingColumns=True)
    order = as_double(F.col("_t"), both.schema["_t"].dataType)
    both = ranged(both.withColumn("_o", F.coalesce(order, F.lit(float("-inf")))), "_o", "_range", RANGES)
    w = Window.partitionBy(by, "_range").orderBy("_t", "_side", F.col("_v").asc_nulls_first())
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.when(F.col("_right"), F.struct(F.col("_v").alias("v")))
    # as many rows a key as ranges; null values sort first in structs as well
    ends = both.groupBy(q(by).alias("_by"), F.col("_range").alias("_r")).agg(F.max(F.when(F.col("_right"), F.struct("_t", "_side", "_v"))).alias("_e"))
    before = Window.partitionBy("_by").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("_e").isNotNull(), F.struct(F.col("_e._v").alias("v"))), ignorenulls=True).over(before)
    ends = ends.select("_by", "_r", carried.alias("_c"))
    filled = both.withColumn("_h", F.last(held, ignorenulls=True).over(w)).where(~F.col("_right"))
    filled = filled.join(ends, q(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")), "left")
    # equal to null matches nothing
    value = F.when(q(by).isNotNull(), F.coalesce("_h", "_c")["v"])
    return filled.withColumn(out, value).select(*left.columns, out)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Rows of points with the intervals [start, end) that hold them: equality on a bucket of the given width, then the bounds."""
    p = points.withColumn("_b", F.floor(q(point) / F.lit(width)).cast("long"))
    i = intervals.withColumn("_b", F.explode(F.sequence(F.floor(q(start) / F.lit(width)).cast("long"), F.floor(q(end) / F.lit(width)).cast("long"))))
    return p.join(i, "_b").where((q(point) >= q(start)) & (q(point) < q(end))).drop("_b")


def mature(df: DataFrame, feature_time: str, cutoff: str, outcome_days: int, delay_days: int) -> DataFrame:
    """Rows whose outcome was known at the cutoff: outcome window and ingestion delay passed; later ones are no negatives."""
    edge = F.lit(cutoff).cast("timestamp_ntz") - F.make_dt_interval(F.lit(outcome_days + delay_days))
    return df.where(q(feature_time) <= edge)


def fold_expansion(df: DataFrame, fold: str, k: int) -> DataFrame:
    """outer_fold, is_validation and the row, for each of the k outer folds (k is a small fixed number)."""
    return df.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_validation", q(fold) == F.col("outer_fold"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """n_a, n_b, n_paired, mean_difference of a value over the row ids that both have."""
    x, y = a.select(q(key).alias("k"), q(value).alias("x")), b.select(q(key).alias("k"), q(value).alias("y"))
    both = x.join(y, "k", "full").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_paired"), F.avg(F.col("y") - F.col("x")).alias("mean_difference"))
    return both
