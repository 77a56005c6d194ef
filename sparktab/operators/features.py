"""Feature builders that never look at the row's own future or fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from .profile import q
from .ranks import quantiles


def _order(entity: str, time: str, key: str):
    return Window.partitionBy(q(entity)).orderBy(q(time), q(key))


def lag_features(df: DataFrame, entity: str, time: str, key: str, value: str, lags: list[int]) -> DataFrame:
    """df with lag_k of the value within each entity, k at least 1."""
    if min(lags) < 1:
        raise ValueError("lags start at 1")
    w = _order(entity, time, key)
    return df.withColumns({f"lag_{k}": F.lag(q(value), k).over(w) for k in lags})


def shifted_rolling(df: DataFrame, entity: str, time: str, key: str, value: str, rows: int) -> DataFrame:
    """df with rolling_mean, rolling_sum and rolling_n over the rows before this one."""
    w = _order(entity, time, key).rowsBetween(-rows, -1)
    return df.withColumns({"rolling_mean": F.avg(q(value)).over(w), "rolling_sum": F.sum(q(value)).over(w), "rolling_n": F.count(q(value)).over(w)})


def shifted_rolling_days(df: DataFrame, entity: str, time: str, value: str, days: int) -> DataFrame:
    """df with rolling_mean and rolling_n over the given days before this row's second."""
    seconds = F.unix_timestamp(q(time).cast("timestamp"))
    w = Window.partitionBy(q(entity)).orderBy(seconds).rangeBetween(-days * 86400, -1)
    return df.withColumns({"rolling_mean": F.avg(q(value)).over(w), "rolling_n": F.count(q(value)).over(w)})


def causal_fill(df: DataFrame, entity: str, time: str, key: str, value: str, out: str) -> DataFrame:
    """df with the value, or where it is null the last known one before it."""
    w = _order(entity, time, key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(q(value), ignorenulls=True).over(w))


def calendar_features(df: DataFrame, time: str) -> DataFrame:
    """df with year, month, day, day_of_week (Monday 1), hour, is_weekend."""
    t = q(time)
    dow = F.weekday(t) + 1
    return df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "day_of_week": dow, "hour": F.hour(t), "is_weekend": dow >= 6})


def missing_indicator(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": q(c).isNull().cast("int") for c in columns})


def fold_median_impute(df: DataFrame, value: str, fold: str, out: str) -> DataFrame:
    """df with nulls of the value replaced by the median over all other folds (exact); a row per fold joins back."""
    folds = df.select(q(fold).alias("f")).distinct()
    known = df.select(q(fold).alias("g"), q(value).alias("v")).where("v IS NOT NULL")
    # as many copies of the known values as folds, combined before the shuffle
    counted = known.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    other = folds.join(counted, F.col("f") != F.col("g")).groupBy("f").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("_fill"))
    return df.join(F.broadcast(other), q(fold) == F.col("f"), "left").withColumn(out, F.coalesce(q(value).cast("double"), "_fill")).drop("f", "_fill")


def frequency_encoding(train: DataFrame, df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the share of training rows that hold the value; 0 for unseen and null values."""
    counts = train.where(q(column).isNotNull()).groupBy(q(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    total = train.agg(F.count(q(column)).alias("_total"))
    shares = counts.crossJoin(F.broadcast(total)).select("_v", (F.col("_n") / F.col("_total")).alias("_share"))
    return df.join(shares, q(column) == F.col("_v"), "left").withColumn(out, F.coalesce("_share", F.lit(0.0))).drop("_v", "_share")


def target_encoding(df: DataFrame, column: str, target: str, fold: str, smoothing: float = 20.0, out: str = "encoded") -> DataFrame:
    """df with the smoothed target mean of the value over all other folds: (S - S_f + m * mu_f) / (N - N_f + m).

    mu_f is the mean over all other folds. Two groupings of (value, fold) make it; no row meets its own fold's targets.
    """
    cell = df.groupBy(q(column).alias("_v"), q(fold).alias("_f")).agg(F.sum(q(target)).alias("s"), F.count(q(target)).alias("n"))
    per_value = cell.groupBy(F.col("_v").alias("_w")).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    per_fold = cell.groupBy("_f").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    every = cell.agg(F.sum("s").alias("as"), F.sum("n").alias("an"))
    prior = per_fold.crossJoin(every).select(F.col("_f").alias("_g"), F.try_divide((F.col("as") - F.coalesce("fs", F.lit(0))).cast("double"), F.col("an") - F.col("fn")).alias("mu"))
    both = cell.join(per_value, F.col("_v").eqNullSafe(F.col("_w"))).select("_v", "_f", "s", "n", "all_s", "all_n").join(F.broadcast(prior), F.col("_f").eqNullSafe(F.col("_g")))
    s, n = F.col("all_s") - F.coalesce("s", F.lit(0)), F.col("all_n") - F.col("n")
    codes = both.select("_v", "_f", ((F.coalesce(s, F.lit(0)) + F.lit(smoothing) * F.col("mu")) / (n + F.lit(smoothing))).alias(out))
    return df.join(codes, q(column).eqNullSafe(F.col("_v")) & q(fold).eqNullSafe(F.col("_f"))).drop("_v", "_f")


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """df with column_level for each training level, and column_other for the rest and null."""
    text = q(column).cast("string")
    wide = {f"{column}_{v}": F.coalesce((text == v).cast("int"), F.lit(0)) for v in levels}
    return df.withColumns(wide | {f"{column}_other": F.coalesce(~text.isin(*levels), F.lit(True)).cast("int")})


def hashed(df: DataFrame, column: str, buckets: int, out: str) -> DataFrame:
    return df.withColumn(out, F.pmod(F.xxhash64(q(column)), F.lit(buckets)).cast("int"))


def standard_scale(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """df with column_z by the training rows' mean and sample deviation; 0 where that is 0."""
    stats = train.agg(*[x for i, c in enumerate(columns) for x in (F.avg(finite(q(c))).alias(f"m{i}"), F.stddev_samp(finite(q(c))).alias(f"s{i}"))]).first()
    z = lambda i, c: (finite(q(c)) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"]) if stats[f"s{i}"] else F.lit(0.0)
    return df.withColumns({f"{c}_z": z(i, c) for i, c in enumerate(columns)})


def winsorise(train: DataFrame, df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, out: str = "winsorised") -> DataFrame:
    """df with the value held between the training rows' quantiles."""
    lo, hi = (F.lit(x).cast("double") for x in quantiles(train, {"x": finite(q(column))}, [low, high])["x"])
    return df.withColumn(out, F.greatest(lo, F.least(hi, finite(q(column)))))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """target_value, n, weight: n_rows / (n_classes * n)."""
    counts = df.where(q(target).isNotNull()).groupBy(q(target).alias("target_value")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(every)).select("target_value", "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def negative_sample(df: DataFrame, target: str, key: list[str], rate: float, seed: int = 7) -> DataFrame:
    """All positives and a hash-chosen share of negatives, with weight 1 / rate for the latter."""
    from .splits import hash_fold

    take = hash_fold(F.concat_ws("|", *[q(k).cast("string") for k in key]), 1_000_000, seed) < int(rate * 1_000_000)
    return df.where((q(target) == 1) | take).withColumn("weight", F.when(q(target) == 1, F.lit(1.0)).otherwise(F.lit(1.0 / rate)))


def tfidf_terms(df: DataFrame, key: str, text: str, top: int = 5) -> DataFrame:
    """key, term, tf, df, tfidf of each text's best terms: tf * ln((1 + n) / (1 + df)); ties by term."""
    words = F.filter(F.split(F.lower(q(text)), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    terms = df.select(q(key).alias("k"), F.explode(words).alias("term")).groupBy("k", "term").agg(F.count(F.lit(1)).alias("tf"))
    docs = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.count(F.lit(1)).alias("n"))
    scored = terms.join(docs, "term").crossJoin(F.broadcast(n)).withColumn("tfidf", F.col("tf") * F.log((1 + F.col("n")) / (1 + F.col("df"))))
    best = scored.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round("tfidf", 9)), "term")))
    return best.where(F.col("i") <= top).select(F.col("k").alias(key), "term", "tf", "df", "tfidf")
