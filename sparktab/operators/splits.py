"""Split builders and audits; folds come from md5, so any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import row_digest
from .distribution import hash_key
from .profile import q


def hash_fold(key: Column, k: int, seed: int = 7) -> Column:
    """The first 8 hex digits of md5(seed|key) modulo k."""
    return (F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("long") % k).cast("int")


def group_split(df: DataFrame, group: str, k: int = 5, seed: int = 7) -> DataFrame:
    """df with fold; all rows of a group share one, without a shuffle. Null groups are one group."""
    return df.withColumn("fold", hash_fold(F.coalesce(q(group).cast("string"), F.lit("")), k, seed))


def stratified_split(df: DataFrame, target: str, key: list[str], k: int = 5, seed: int = 7) -> DataFrame:
    """df with fold; each class is dealt round the folds in order of md5(seed|key), so counts differ by one at most.

    A class's rows are numbered in 256 ranges of the hash and the ranges' totals added, so a hot class isn't one task.
    """
    h = hash_key(seed, *map(q, key))
    cut = df.withColumn("_h", h).withColumn("_b", F.substring(h, 1, 2))
    inner = Window.partitionBy(q(target), "_b").orderBy("_h", *map(q, key))
    sizes = cut.groupBy(q(target).alias("_t"), F.col("_b").alias("_bb")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_t").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = cut.withColumn("_i", F.row_number().over(inner)).join(sizes, q(target).eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_bb")))
    return placed.withColumn("fold", ((F.col("_before") + F.col("_i") - 1) % k).cast("int")).drop("_h", "_b", "_t", "_bb", "_n", "_before", "_i")


def signature_split(df: DataFrame, features: list[str], k: int = 5, seed: int = 7) -> DataFrame:
    """df with fold; equal feature vectors (null-safe) share one."""
    return df.withColumn("fold", hash_fold(row_digest(features), k, seed))


def rolling_origin(df: DataFrame, time: str, cutoffs: list[str], horizon_days: int, purge_days: int = 0, window_days: int | None = None) -> DataFrame:
    """Rows with origin (from 0) and part: train up to the cutoff less the purge (expanding, or of window_days), test within the horizon."""
    edges = F.array(*[F.struct(F.lit(i).alias("origin"), F.lit(c).cast("timestamp_ntz").alias("cutoff")) for i, c in enumerate(cutoffs)])
    days = lambda n: F.make_dt_interval(F.lit(n))
    wide = df.withColumn("_o", F.explode(edges)).select(*map(q, df.columns), "_o.origin", "_o.cutoff")
    t = q(time).cast("timestamp_ntz")
    train = t < F.col("cutoff") - days(purge_days)
    if window_days is not None:
        train &= t >= F.col("cutoff") - days(purge_days + window_days)
    test = (t >= F.col("cutoff")) & (t < F.col("cutoff") + days(horizon_days))
    return wide.withColumn("part", F.when(train, "train").when(test, "test")).where("part IS NOT NULL")


def grouped_temporal(df: DataFrame, group: str, time: str, cutoff: str, k: int = 5, held: int = 0, seed: int = 7) -> DataFrame:
    """df with part: train (other groups, before), test (held groups, from the cutoff on), excluded (the rest)."""
    mine = hash_fold(F.coalesce(q(group).cast("string"), F.lit("")), k, seed) == held
    late = q(time).cast("timestamp_ntz") >= F.lit(cutoff).cast("timestamp_ntz")
    return df.withColumn("part", F.when(mine & late, "test").when(~mine & ~late, "train").otherwise("excluded"))


def nested_folds(df: DataFrame, key: str, outer: int = 5, inner: int = 3, seed: int = 7) -> DataFrame:
    """df with outer_fold and inner_fold, of independent hashes."""
    text = F.coalesce(q(key).cast("string"), F.lit(""))
    return df.withColumn("outer_fold", hash_fold(text, outer, seed)).withColumn("inner_fold", hash_fold(text, inner, seed + 1))


def overlap(df: DataFrame, group: str, fold: str) -> DataFrame:
    """n_groups, n_crossing: groups, and those that more than one fold holds."""
    per = df.where(q(group).isNotNull() & q(fold).isNotNull()).groupBy(q(group)).agg(F.count_distinct(q(fold)).alias("f"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("f") > 1).alias("n_crossing"))


def crossing_groups(df: DataFrame, group: str, fold: str, most: int = 5) -> DataFrame:
    """The first groups, by their text, that more than one fold holds."""
    per = df.where(q(group).isNotNull() & q(fold).isNotNull()).groupBy(q(group).cast("string").alias("group_value")).agg(F.count_distinct(q(fold)).alias("n_folds"))
    return per.where("n_folds > 1").orderBy("group_value").limit(most)


def _cells(df: DataFrame, fold: str, target: str) -> DataFrame:
    label = F.coalesce(q(fold).cast("string"), F.lit("(missing)"))
    return df.groupBy(label.alias("partition"), q(target).cast("string").alias("t")).agg(F.count(F.lit(1)).alias("n"))


def fold_audit(df: DataFrame, fold: str, target: str) -> DataFrame:
    """partition, n_rows, n_classes, least_support, n_missing: for each fold, null as (missing), how many of all classes it
    lacks. Counts alone, so a target of many classes makes no long value; missing_classes lists them."""
    cells = _cells(df, fold, target)
    every = df.where(q(target).isNotNull()).select(q(target).cast("string").alias("t")).distinct().agg(F.count(F.lit(1)).alias("every"))
    per = cells.groupBy("partition").agg(F.sum("n").alias("n_rows"), F.count("t").alias("n_classes"), F.min(F.when(F.col("t").isNotNull(), F.col("n"))).alias("least_support"))
    return per.crossJoin(F.broadcast(every)).select("partition", "n_rows", "n_classes", "least_support", (F.col("every") - F.col("n_classes")).alias("n_missing"))


def missing_classes(df: DataFrame, fold: str, target: str) -> DataFrame:
    """partition, class: one row for each class that a fold lacks, whatever characters it holds.

    Only folds that lack a class meet the classes, and the result is as large as what is missing.
    """
    lacking = fold_audit(df, fold, target).where("n_missing > 0").select("partition")
    classes = df.where(q(target).isNotNull()).select(q(target).cast("string").alias("class")).distinct()
    seen = _cells(df, fold, target).where("t IS NOT NULL").select("partition", F.col("t").alias("class"))
    return lacking.join(classes).join(seen, ["partition", "class"], "left_anti")


def fold_audit_by_name(df: DataFrame, fold: str, target: str) -> DataFrame:
    """fold_audit's columns and missing_classes: the classes that the fold lacks, sorted, as a JSON array of texts.

    A row is as long as the names of what its fold lacks; missing_classes has them as rows.
    """
    audit = fold_audit(df, fold, target)
    names = missing_classes(df, fold, target).groupBy("partition").agg(F.to_json(F.sort_array(F.collect_list("class"))).alias("missing_classes"))
    return audit.join(names, "partition", "left").select(*audit.columns, F.coalesce("missing_classes", F.lit("[]")).alias("missing_classes"))


def split_fingerprint(df: DataFrame, key: str, fold: str) -> DataFrame:
    """fold, n, fingerprint: sha256 of the fold's row count and of the sums of four 60-bit parts of its keys' sha256.

    Sums don't depend on order and merge map-side, so no task holds a fold.
    """
    digest = F.sha2(q(key).cast("string").cast("binary"), 256)
    part = lambda i: F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)").alias(f"s{i}")
    rows = df.select(q(fold).alias("fold"), *[part(i) for i in range(4)])
    sums = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{i}").cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select("fold", "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("fingerprint"))
