"""Joins of intervals with intervals, and folds purged by label intervals.

Intervals are half open; a null bound, or an end not after the start, makes an interval that overlaps nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged
from .profile import q
from .ranks import as_double, ranged, running_sums

#: A level's cells are this many times as wide as those of the level below.
BASE = 4
#: Rows that a range of the running maximum holds on average.
RANGE_ROWS = 1_000_000


def _bounds(df: DataFrame, start: str, end: str) -> DataFrame:
    kind = lambda c: df.schema[c].dataType
    rows = df.withColumns({"_s": as_double(q(start), kind(start)), "_e": as_double(q(end), kind(end))})
    return rows.where(F.col("_s") < F.col("_e"))


def overlap_join(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, width: float, by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of rows whose intervals overlap, and whose columns of by are equal; columns of right that left has too get `_right`.

    Each interval is kept in the cells of the level whose cells are just wider than it is, two of them at most, so a very
    long one makes no more rows than a short one. The shorter of two intervals looks the other up at the other's level: left
    rows at the levels from their own on that right rows are kept at, right rows at the levels above their own that left rows
    are kept at. A pair comes out in the cell that holds the later start, once. width, in the unit of the bounds (microseconds
    for times), is that of the lowest cells; it changes the speed only.
    """
    named = {c: f"{c}_right" if c in left.columns else c for c in right.columns}
    a = _bounds(left, left_start, left_end)
    b = _bounds(right, right_start, right_end).select(*[q(c).alias(n) for c, n in named.items()], F.col("_s").alias("_s2"), F.col("_e").alias("_e2"))
    level = lambda s, e: F.greatest(F.lit(0), F.ceil(F.log((F.col(e) - F.col(s)) / width) / math.log(BASE))).cast("int")
    a, b = a.withColumn("_l", level("_s", "_e")), b.withColumn("_l2", level("_s2", "_e2"))
    size = lambda l: F.lit(width) * F.pow(F.lit(float(BASE)), l)
    # some forty levels span all doubles of a table's times
    levels = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())

    def cells(df: DataFrame, at: Column, s: str, e: str) -> DataFrame:
        spread = F.transform(at, lambda l: F.transform(F.sequence(F.floor(F.col(s) / size(l)), F.floor(F.col(e) / size(l))), lambda c: F.struct(l.alias("l"), c.alias("c"))))
        return df.withColumn("_cell", F.explode(F.flatten(spread))).withColumns({"_cl": F.col("_cell.l"), "_cc": F.col("_cell.c")}).drop("_cell")

    above = lambda own, found: F.filter(F.array(*[F.lit(x) for x in found]).cast("array<int>"), own)
    met = None
    for x, y in (
        (cells(a, above(lambda l: l >= F.col("_l"), levels(b, "_l2")), "_s", "_e"), cells(b, F.array("_l2"), "_s2", "_e2")),
        (cells(a, F.array("_l"), "_s", "_e"), cells(b, above(lambda l: l > F.col("_l2"), levels(a, "_l")), "_s2", "_e2")),
    ):
        x, y = x.drop("_l"), y.drop("_l2").withColumnsRenamed({"_cl": "_cl2", "_cc": "_cc2"})
        on = (F.col("_cl") == F.col("_cl2")) & (F.col("_cc") == F.col("_cc2"))
        for l, r in by:
            on &= q(l) == q(named[r])
        pairs = x.join(y, on).where((F.col("_s") < F.col("_e2")) & (F.col("_s2") < F.col("_e")) & (F.floor(F.greatest("_s", "_s2") / size(F.col("_cl"))) == F.col("_cc")))
        pairs = pairs.select(*map(q, left.columns), *[q(n) for n in named.values()])
        met = pairs if met is None else met.unionByName(pairs)
    return met


def overlap_totals(left: DataFrame, right: DataFrame, left_start: str, left_end: str, right_start: str, right_end: str, n: str = "n", total: str = "total") -> DataFrame:
    """The rows of left that overlap rows of right, with how many those are and how long they overlap it in all.

    No pair is made. Of the rows of right, as many overlap [s, e) as start before e, less those that end by s; the time that
    they cover before t is t times those open at t, less the sum of the starts before t, plus that of the ends. Counts and
    sums come from one running sum over the distinct bounds of both sides, within ranges. Totals of times are whole
    microseconds (decimals, exact), totals of numbers doubles.
    """
    times = all(isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for df, c in ((left, left_start), (left, left_end), (right, right_start), (right, right_end)))
    exact = (lambda c: c.cast("decimal(38,0)")) if times else (lambda c: c)
    a, b = _bounds(left, left_start, left_end), _bounds(right, right_start, right_end)
    bound = lambda df, c, starts, ends: df.select(F.col(c).alias("t"), F.lit(starts).cast("long").alias("starts"), F.lit(ends).cast("long").alias("ends"))
    events = bound(b, "_s", 1, 0).unionByName(bound(b, "_e", 0, 1)).unionByName(bound(a, "_s", 0, 0)).unionByName(bound(a, "_e", 0, 0))
    per = staged(events.groupBy("t").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends")))
    per = per.withColumn("moment", exact(F.col("t")) * (F.col("starts") - F.col("ends")))
    summed = running_sums(per, "t", {"starts": "begun", "ends": "ended", "moment": "moments"})
    covered = exact(F.col("t")) * (F.col("begun") - F.col("ended")) - F.col("moments")
    at = staged(summed.select("t", "begun", (F.col("ended") + F.col("ends")).alias("over"), covered.alias("covered")))
    first = at.select(F.col("t").alias("_s"), F.col("over").alias("_o"), F.col("covered").alias("_c1"))
    last = at.select(F.col("t").alias("_e"), F.col("begun").alias("_b"), F.col("covered").alias("_c2"))
    met = a.join(first, "_s").join(last, "_e").where(F.col("_b") > F.col("_o"))
    return met.select(*map(q, left.columns), (F.col("_b") - F.col("_o")).alias(n), (F.col("_c2") - F.col("_c1")).alias(total))


def latest_end_before(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, out: str) -> DataFrame:
    """points with the largest end of all spans of the same `by` that start before at; at, start and end are doubles.

    One union and one running maximum within ranges of about RANGE_ROWS rows, with each range's maximum carried on: no pair of
    rows is made and no task holds a whole key.
    """
    a = points.withColumns({"_t": q(at), "_v": F.lit(None).cast("double"), "_span": F.lit(False)})
    b = spans.select(q(by).alias(by), q(start).alias("_t"), q(end).alias("_v"), F.lit(True).alias("_span"))
    both = a.unionByName(b, allowMissingColumns=True).where("_t IS NOT NULL")
    both = ranged(both, "_t", "_r", max(2, -(-both.count() // RANGE_ROWS)))
    # rows of one time come before the spans that start then
    order = Window.partitionBy(by, "_r").orderBy("_t", "_span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_m", F.max("_v").over(order)).where("NOT _span")
    tops = both.groupBy(q(by).alias("_b"), F.col("_r").alias("_q")).agg(F.max("_v").alias("_top"))
    before = Window.partitionBy("_b").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_b", "_q", F.max("_top").over(before).alias("_c"))  # a row for each key and range
    joined = inside.join(tops, q(by).eqNullSafe(F.col("_b")) & (F.col("_r") == F.col("_q")), "left")
    return joined.select(*map(q, points.columns), F.greatest("_m", "_c").alias(out))


def purged_folds(df: DataFrame, fold: str, k: int, label_start: str, label_end: str, embargo: float = 0.0) -> DataFrame:
    """df with outer_fold and role for each of k outer folds (0 to k - 1): 'validation' for the fold's own rows, 'purged' for
    rows whose label interval overlaps that of any validation row, 'embargoed' for other rows that start within embargo after
    the last validation label ends, 'train' for the rest. Times and embargo are in microseconds, numbers in their own unit.

    Rows without a valid interval can't be shown to be clear of the validation rows: they are 'purged'.
    """
    kind = lambda c: df.schema[c].dataType
    rows = df.withColumns({"_s": as_double(q(label_start), kind(label_start)), "_e": as_double(q(label_end), kind(label_end))})
    valid = rows.where(F.col("_s") < F.col("_e"))
    spans = valid.where(q(fold).between(0, k - 1)).select(q(fold).cast("int").alias("outer_fold"), F.col("_s").alias("_vs"), F.col("_e").alias("_ve"))
    ends = spans.groupBy(F.col("outer_fold").alias("_f")).agg(F.max("_ve").alias("_last"))  # k rows
    wide = rows.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    own = q(fold).cast("int").eqNullSafe(F.col("outer_fold"))
    plain = wide.where(own | ~F.coalesce(F.col("_s") < F.col("_e"), F.lit(False)))
    plain = plain.withColumn("role", F.when(own, "validation").otherwise("purged"))
    asked = wide.where(~own & (F.col("_s") < F.col("_e")))
    seen = latest_end_before(asked, spans, "outer_fold", "_e", "_vs", "_ve", "_seen").join(F.broadcast(ends), F.col("outer_fold") == F.col("_f"), "left")
    late = (F.col("_s") >= F.col("_last")) & (F.col("_s") < F.col("_last") + F.lit(float(embargo)))
    seen = seen.withColumn("role", F.when(F.col("_seen") > F.col("_s"), "purged").when(late, "embargoed").otherwise("train"))
    columns = [*map(q, df.columns), "outer_fold", "role"]
    return plain.select(*columns).unionByName(seen.select(*columns))
