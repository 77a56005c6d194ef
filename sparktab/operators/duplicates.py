"""Duplicate rows and feature signatures. Grouping treats null as a value, so no row is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import q


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n_rows, n_distinct, n_repeated: rows that repeat an earlier one over the columns (all by default)."""
    columns = columns or df.columns
    counts = df.groupBy(*map(q, columns)).agg(F.count(F.lit(1)).alias("n"))
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("n_repeated", F.col("n_rows") - F.col("n_distinct"))


def signatures(df: DataFrame, features: list[str], target: str | None = None, group: str | None = None) -> DataFrame:
    """One row per distinct feature vector: rows, distinct targets, distinct groups.

    Counting distinct targets and groups goes by a first grouping on (features, target, group), so a hot signature is
    combined before the shuffle.
    """
    keys = [q(f).alias(f"f{i}") for i, f in enumerate(features)]
    extra = [q(target).alias("t") if target else F.lit(None).cast("string").alias("t"), q(group).alias("g") if group else F.lit(None).cast("string").alias("g")]
    once = df.groupBy(*keys, *extra).agg(F.count(F.lit(1)).alias("n"))
    per = once.groupBy(*[f"f{i}" for i in range(len(features))]).agg(F.sum("n").alias("n"), F.count_distinct("t").alias("targets"), F.count_distinct("g").alias("groups"))
    return per.withColumnsRenamed({f"f{i}": f for i, f in enumerate(features)})


def signature_summary(df: DataFrame, features: list[str], target: str | None = None, group: str | None = None) -> DataFrame:
    """n_signatures, n_repeated_signatures, n_repeated_rows, n_conflicting, n_across_groups, n_conflicting_across_groups."""
    keys = [q(f).alias(f"f{i}") for i, f in enumerate(features)]
    nothing = F.lit(None).cast("string")
    extra = [q(c).alias(n) if c else nothing.alias(n) for c, n in ((target, "t"), (group, "g"))]
    # two values or more: the least is below the greatest; no count of distinct ones is needed
    per = df.groupBy(*keys, *extra).agg(F.count(F.lit(1)).alias("n")).groupBy(*[f"f{i}" for i in range(len(features))])
    several = lambda c, out: F.when(F.min(c) < F.max(c), 2).otherwise(1).alias(out)
    s = per.agg(F.sum("n").alias("n"), several("t", "targets"), several("g", "groups"))
    return s.agg(
        F.count(F.lit(1)).alias("n_signatures"),
        F.count_if(F.col("n") > 1).alias("n_repeated_signatures"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_repeated_rows"),
        F.count_if(F.col("targets") > 1).alias("n_conflicting"),
        F.count_if(F.col("groups") > 1).alias("n_across_groups"),
        F.count_if((F.col("groups") > 1) & (F.col("targets") > 1)).alias("n_conflicting_across_groups"),
    )


def target_by_group(df: DataFrame, group: str, target: str) -> DataFrame:
    """n_groups, n_targets, is_function: whether every group has one target at most, with two groups and two targets."""
    per = df.where(q(group).isNotNull()).groupBy(q(group)).agg(F.count_distinct(q(target)).alias("t")).agg(F.count(F.lit(1)).alias("n_groups"), F.max("t").alias("most"))
    both = per.crossJoin(df.agg(F.count_distinct(q(target)).alias("n_targets")))  # one row each
    return both.select("n_groups", "n_targets", ((F.col("n_groups") >= 2) & (F.col("n_targets") >= 2) & (F.col("most") <= 1)).alias("is_function"))
