"""Column profiles: fused aggregates for all columns, distinct counts by unpivoting, exact quartiles."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_timestamp, finite, infinite
from ..functions.types import CATEGORY, NUMERIC, ColumnFacts, logical_type, role
from . import ranks

#: Columns whose aggregates share one pass; wider code may not be compiled.
CHUNK = 40


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def logical_types(df: DataFrame) -> dict[str, str]:
    return {f.name: logical_type(f.dataType) for f in df.schema.fields}


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_rows, n_missing, missing_rate: one pass over all columns."""
    columns = columns or df.columns
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("seen")) for i, c in enumerate(columns)])
    out = counted.select("n", F.explode(rows).alias("r")).select("r.column_name", F.col("n").alias("n_rows"), (F.col("n") - F.col("r.seen")).alias("n_missing"))
    return out.withColumn("missing_rate", F.when(F.col("n_rows") > 0, F.col("n_missing") / F.col("n_rows")).otherwise(F.lit(0.0)))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (as text), n: counts of each column's non-null values, one unpivot for each type."""
    by_type: dict[str, list[str]] = defaultdict(list)
    kinds = dict(df.dtypes)
    for c in columns or df.columns:
        by_type[kinds[c]].append(c)
    parts = []
    for kind, names in by_type.items():
        value = lambda c, kind=kind: F.to_json(F.struct(q(c).alias("v"))) if kind.startswith(("array", "struct", "map")) else q(c)
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), value(c).alias("value")) for c in names])
        long = df.select(F.explode(pairs).alias("p")).select("p.column_name", "p.value").where("value IS NOT NULL")
        parts.append(long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).select("column_name", F.col("value").cast("string").alias("value"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_distinct (non-null values); columns without values have 0."""
    columns = columns or df.columns
    counted = value_counts(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column_name"))
    return names.join(counted, "column_name", "left").select("column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def approx_distinct_counts(df: DataFrame, columns: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """column_name, n_distinct, is_approx: HyperLogLog counts, marked as such."""
    columns = columns or df.columns
    row = df.agg(*[F.approx_count_distinct(q(c), rsd).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").alias("n_distinct"), F.lit(True).alias("is_approx")) for i, c in enumerate(columns)])
    return row.select(F.explode(rows).alias("r")).select("r.*")


def constant_columns(df: DataFrame) -> DataFrame:
    return distinct_counts(df).where("n_distinct <= 1").select("column_name", "n_distinct")


def numeric_summary(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """column_name, n_finite, n_infinite, min, q1, median, q3, max, mean, std, outliers_iqr.

    Fused passes over all columns make moments, exact quartiles (linear interpolation; see ranks.py; or approximate ones if
    asked) and the counts of values beyond 1.5 interquartile ranges, fences as literals. Columns without a finite value
    have nulls. Returns one row per column.
    """
    rows: list[tuple] = []
    for at in range(0, len(columns), CHUNK):
        some = columns[at : at + CHUNK]
        aggs = []
        for i, c in enumerate(some):
            x = finite(q(c))
            quart = F.percentile_approx(x, [0.25, 0.5, 0.75], 100_000) if approximate else F.lit(None).cast("array<double>")
            parts = [F.count(x).alias("n"), F.count_if(infinite(q(c))).alias("inf"), F.min(x).alias("lo"), quart.alias("q")]
            aggs.append(F.struct(*parts, F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).alias(f"s{i}"))
        if approximate:
            first = df.agg(*aggs).first().asDict(recursive=True)
        else:
            exact, got = ranks.quantiles_with(df, {c: finite(q(c)) for c in some}, [0.25, 0.5, 0.75], aggs)
            first = got.asDict(recursive=True)
            for i, c in enumerate(some):
                first[f"s{i}"]["q"] = exact[c]
        fences = []
        for i, c in enumerate(some):
            s = first[f"s{i}"]
            spread = (s["q"][2] - s["q"][0]) if s["n"] else 0.0
            x = finite(q(c))
            beyond = (x < s["q"][0] - 1.5 * spread) | (x > s["q"][2] + 1.5 * spread) if spread > 0 else F.lit(False)
            fences.append(F.count_if(beyond).alias(f"o{i}"))
        second = df.agg(*fences).first()
        for i, c in enumerate(some):
            s = first[f"s{i}"]
            quarts = [float(v) for v in s["q"]] if s["n"] else [None] * 3
            rows.append((c, s["n"], s["inf"], s["lo"], *quarts, s["hi"], s["mean"], s["std"], second[f"o{i}"], approximate))
    schema = "column_name string, n_finite long, n_infinite long, min double, q1 double, median double, q3 double, max double, mean double, std double, outliers_iqr long, is_approx boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def facts(df: DataFrame, approximate: bool = False, summaries: bool = True) -> list[ColumnFacts]:
    """Facts of every column, for roles and findings; a few jobs whatever the number of rows.

    Without summaries numbers have no quartiles and text isn't parsed for times.
    """
    kinds = logical_types(df)
    missing = {r["column_name"]: (r["n_rows"], r["n_missing"]) for r in missing_rates(df).collect()}
    distinct = {r["column_name"]: r["n_distinct"] for r in (approx_distinct_counts(df) if approximate else distinct_counts(df)).collect()}
    texts = [f for f in df.schema.fields if kinds[f.name] == CATEGORY and summaries]
    dated = df.agg(*[F.count(as_timestamp(q(f.name), f.dataType)).alias(f"t{i}") for i, f in enumerate(texts)]).first() if texts else []
    parsed = {f.name: dated[i] for i, f in enumerate(texts)}
    numbers = [c for c in df.columns if kinds[c] == NUMERIC and summaries]
    summary = {r["column_name"]: r.asDict() for r in numeric_summary(df, numbers, approximate).collect()} if numbers else {}
    return [ColumnFacts(c, kinds[c], missing[c][0], missing[c][1], distinct[c], parsed.get(c, 0), summary.get(c, {})) for c in df.columns]


def profile(df: DataFrame, target: str | None = None, time: str | None = None, group: str | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: position, logical type, role, missing and distinct counts, numeric summary."""
    rows = []
    for i, f in enumerate(facts(df, approximate)):
        s = f.numeric
        rows.append((f.name, i, f.logical, role(f, target, time, group), f.rows, f.missing, f.missing_rate, f.distinct, *[s.get(k) for k in ("min", "q1", "median", "q3", "max", "mean", "std", "outliers_iqr", "n_infinite")], approximate))
    schema = "column_name string, position int, logical_type string, role string, n_rows long, n_missing long, missing_rate double, n_distinct long, min double, q1 double, median double, q3 double, max double, mean double, std double, outliers_iqr long, n_infinite long, is_approx boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def class_support(df: DataFrame, target: str) -> DataFrame:
    """class (as text), n: rows of each observed class."""
    return df.where(q(target).isNotNull()).groupBy(q(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, target: str, most: int = 20) -> DataFrame:
    """n_classes, largest, smallest, ratio of a target of at most that many classes."""
    counts = df.where(q(target).isNotNull()).groupBy(q(target)).agg(F.count(F.lit(1)).alias("n"))
    out = counts.agg(F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    return out.where(F.col("n_classes") <= most).withColumn("ratio", F.try_divide(F.col("largest").cast("double"), "smallest"))


def group_structure(df: DataFrame, group: str) -> DataFrame:
    """n_groups, singletons, largest, smallest, missing_rows."""
    counts = df.groupBy(q(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    has = F.col("g").isNotNull()
    return counts.agg(F.count_if(has).alias("n_groups"), F.count_if(has & (F.col("n") == 1)).alias("singletons"), F.max(F.when(has, F.col("n"))).alias("largest"), F.min(F.when(has, F.col("n"))).alias("smallest"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("missing_rows"))


def time_coverage(df: DataFrame, column: str) -> DataFrame:
    """first, last, invalid (values that are no times), missing."""
    t = as_timestamp(q(column), df.schema[column].dataType)
    return df.agg(F.min(t).alias("first"), F.max(t).alias("last"), (F.count(q(column)) - F.count(t)).alias("invalid"), F.count_if(q(column).isNull()).alias("missing"))


def is_monotonic(df: DataFrame, column: str, *order: str | Column) -> DataFrame:
    """monotonic: whether times never fall along order; a value that is no time makes it false.

    Rows are compared within ranges of order and the ranges' ends with one another, so no task holds all rows.
    """
    t = as_timestamp(q(column), df.schema[column].dataType)
    dealt = df.select(F.struct(*[q(o) if isinstance(o, str) else o for o in order]).alias("o"), t.alias("t")).repartitionByRange("o").sortWithinPartitions("o")
    parts = dealt.withColumn("p", F.spark_partition_id())
    inner = parts.withColumn("before", F.lag("t").over(Window.partitionBy("p").orderBy("o")))
    ends = inner.groupBy("p").agg(F.min("o").alias("o"), F.min_by("t", "o").alias("first"), F.max_by("t", "o").alias("last"), F.count_if(F.col("t").isNull()).alias("bad"), F.count_if(F.col("before") > F.col("t")).alias("falls"))
    seams = ends.withColumn("before", F.lag("last").over(Window.orderBy("o")))
    return seams.agg((F.coalesce(F.sum("bad"), F.lit(0)) + F.coalesce(F.sum("falls"), F.lit(0)) + F.count_if(F.col("before") > F.col("first")) == 0).alias("monotonic"))



