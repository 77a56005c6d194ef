"""Association between columns: correlations, correlation ratio, Cramer's V, conditional statistics, target copies."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, same_value
from . import ranks
from .profile import q


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """left_column, right_column, n, r: all pairs, PAIRS of them a pass; r is null where a column is constant."""
    return _correlations(df, list(combinations(columns, 2)), "left_column", "right_column")


#: Pairs whose correlations share one pass; wider code may not be compiled.
PAIRS = 24


def _correlations(df: DataFrame, pairs: list[tuple[str, str]], left: str, right: str) -> DataFrame:
    """left, right, n, r of the pairs. The finite doubles are made once a row; rows where one is null count for no pair."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    numbers = df.select(*[finite(q(c)).alias(f"x{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"x{i}") for i, c in enumerate(names)}
    parts = []
    for start in range(0, len(pairs), PAIRS):
        some = pairs[start : start + PAIRS]
        sums = ((F.regr_sxy, "p"), (F.regr_sxx, "s"), (F.regr_syy, "t"), (F.regr_count, "n"))
        aggs = [f(at[a], at[b]).alias(f"{name}{i}") for i, (a, b) in enumerate(some) for f, name in sums]
        r = lambda i: F.try_divide(F.col(f"p{i}"), F.sqrt(f"s{i}") * F.sqrt(f"t{i}"))
        rows = [F.struct(F.lit(a).alias(left), F.lit(b).alias(right), F.col(f"n{i}").alias("n"), r(i).alias("r")) for i, (a, b) in enumerate(some)]
        parts.append(numbers.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], f"{left} string, {right} string, n long, r double")
    return reduce(DataFrame.unionByName, parts)


def near_perfect(df: DataFrame, features: list[str], target: str, least: float = 0.995) -> DataFrame:
    """feature, n, r of numeric features whose correlation with the target is least or more over three rows or more."""
    found = _correlations(df, [(f, target) for f in features], "feature", "other")
    return found.where((F.col("n") >= 3) & (F.abs("r") >= least)).select("feature", "n", "r")


def eta_squared(df: DataFrame, category: str, measure: str) -> DataFrame:
    """n, n_groups, eta_squared: between-group share of the variance of finite values, 0 where it isn't defined."""
    pairs = df.select(q(category).alias("g"), finite(q(measure)).alias("x")).where("g IS NOT NULL AND x IS NOT NULL")
    per = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    got = per.agg(n.alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), mean.alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("sq") - F.col("n") * F.col("mean") * F.col("mean")
    value = F.try_divide(between, between + F.col("within"))
    fine = (F.col("n") >= 3) & (F.col("n_groups") >= 2) & (between + F.col("within") > 0)
    return got.select(F.coalesce("n", F.lit(0)).alias("n"), "n_groups", F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(F.lit(0.0)).alias("eta_squared"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n over rows where both are known (long form)."""
    return df.where(q(a).isNotNull() & q(b).isNotNull()).groupBy(q(a).alias("a"), q(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, n_rows, n_columns, cramers_v without correction, 0 where it isn't defined; zero cells count through the margins."""
    cells = crosstab(df, a, b)
    cells = cells.withColumn("r", F.sum("n").over(Window.partitionBy("a"))).withColumn("c", F.sum("n").over(Window.partitionBy("b")))
    got = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("a").alias("n_rows"), F.count_distinct("b").alias("n_columns"), F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c")).cast("double")).alias("s"))
    least = F.least("n_rows", "n_columns") - 1
    value = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("s") - 1, least)))
    return got.select("n", "n_rows", "n_columns", F.when((F.col("n") >= 3) & (least >= 1), value).otherwise(F.lit(0.0)).alias("cramers_v"))


def conditional_medians(df: DataFrame, target: str, measure: str) -> DataFrame:
    """target_value, n, median of the measure's finite values for each class."""
    pairs = df.select(q(target).alias("target_value"), finite(q(measure)).alias("x")).where("target_value IS NOT NULL AND x IS NOT NULL")
    return ranks.grouped_median(pairs, "target_value", "x")


def conditional_target_median(df: DataFrame, category: str, target: str, top: int = 5) -> DataFrame:
    """category, n, median of a numeric target for the most frequent categories; ties by category."""
    pairs = df.select(q(category).alias("category"), finite(q(target)).alias("y")).where("category IS NOT NULL AND y IS NOT NULL")
    best = pairs.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(top).select("category")
    return ranks.grouped_median(pairs.join(F.broadcast(best), "category"), "category", "y")


def conditional_composition(df: DataFrame, category: str, target: str, levels: int = 4, shares: int = 5) -> DataFrame:
    """level, target_value, n, share: target shares within the most frequent levels; ties by value."""
    cells = crosstab(df, category, target)
    best = cells.groupBy("a").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "a").limit(levels)
    cells = cells.join(F.broadcast(best), "a").withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b")))
    return cells.where(F.col("k") <= shares).select(F.col("a").alias("level"), F.col("b").alias("target_value"), "n", (F.col("n") / F.col("total")).alias("share"))


def target_copies(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """column_name, n_pairs, n_unequal, is_copy: whether values equal the target's wherever both are known; one pass."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in columns or df.columns if c != target]
    aggs = []
    for i, c in enumerate(columns):
        both = q(c).isNotNull() & q(target).isNotNull()
        same = same_value(q(c), kinds[c], q(target), kinds[target])
        aggs += [F.count_if(both).alias(f"n{i}"), F.count_if(both & ~same).alias(f"u{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_pairs"), F.col(f"u{i}").alias("n_unequal"), ((F.col(f"n{i}") > 0) & (F.col(f"u{i}") == 0)).alias("is_copy")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
