"""Evaluation metrics, slices and resampled uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import q
from .ranks import quantiles, running_sums
from .splits import hash_fold


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(q(label).alias("label"), q(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """label, support, precision, recall, f1 for each class, from the confusion counts alone."""
    cells = confusion(df, label, predicted)
    wide = cells.select(F.explode(F.array(F.struct(F.col("label").alias("c"), "n", F.lit(0).cast("long").alias("m"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("n"), F.col("n").alias("m"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = wide.groupBy(F.col("c").alias("label")).agg(F.sum("n").alias("support"), F.sum("m").alias("_p"), F.sum("hit").alias("_hit"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return per.select("label", "support", zero(F.col("_hit"), F.col("_p")).alias("precision"), zero(F.col("_hit"), F.col("support")).alias("recall"), zero(2 * F.col("_hit"), F.col("support") + F.col("_p")).alias("f1"))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """n, accuracy, macro_f1 (mean over classes with support)."""
    per = classification_metrics(df, label, predicted).where("support > 0")
    return per.agg(F.sum("support").alias("n"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Scores in order with positives and negatives of each, ties together."""
    return df.where(q(score).isNotNull() & q(label).isNotNull()).groupBy(q(score).cast("double").alias("s")).agg(F.sum((q(label) == 1).cast("long")).alias("p"), F.sum((q(label) != 1).cast("long")).alias("m"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """n_positive, n_negative, auc: chance that a positive outranks a negative, ties counting half."""
    per = running_sums(_by_score(df, label, score), "s", {"p": "above"}, descending=True)
    got = per.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_positive"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_negative"), F.sum(F.col("m").cast("double") * (F.col("above") + F.col("p") / 2.0)).alias("w"))
    return got.select("n_positive", "n_negative", F.try_divide("w", F.col("n_positive").cast("double") * F.col("n_negative")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """n_positive, average_precision: precision at each score weighted by its gain of recall."""
    per = running_sums(_by_score(df, label, score), "s", {"p": "hits", "m": "misses"}, descending=True)
    hits, misses = F.col("hits") + F.col("p"), F.col("misses") + F.col("m")
    got = per.agg(F.sum("p").alias("n_positive"), F.sum(F.col("p") * hits / (hits + misses)).alias("w"))
    return got.select("n_positive", F.try_divide("w", F.col("n_positive")).alias("average_precision"))


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, n, hits, misses, recall, false_positive_rate, precision, lift: what lies at or above each distinct score.

    The points of the ROC, precision-recall and lift curves, ties as one point; rates without a denominator are null.
    """
    per = running_sums(_by_score(df, label, score), "s", {"p": "above", "m": "beside"}, descending=True)
    total = per.agg(F.sum("p").alias("_p"), F.sum("m").alias("_m"))  # one row
    hits, misses = F.col("above") + F.col("p"), F.col("beside") + F.col("m")
    rate = lambda a, b: F.try_divide(a.cast("double"), b)
    out = per.crossJoin(F.broadcast(total)).select(F.col("s").alias("threshold"), (hits + misses).alias("n"), hits.alias("hits"), misses.alias("misses"), "_p", "_m")
    precision = rate(F.col("hits"), F.col("n"))
    return out.select(
        "threshold", "n", "hits", "misses", rate(F.col("hits"), F.col("_p")).alias("recall"), rate(F.col("misses"), F.col("_m")).alias("false_positive_rate"), precision.alias("precision"),
        F.try_divide(precision, rate(F.col("_p"), F.col("_p") + F.col("_m"))).alias("lift"),
    )


def probability_scores(df: DataFrame, label: str, score: str, edge: float = 1e-15) -> DataFrame:
    """n, log_loss, brier."""
    p = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), q(score)))
    y = (q(label) == 1).cast("double")
    return df.where(q(score).isNotNull() & q(label).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((q(score) - y) * (q(score) - y)).alias("brier"))


def calibration_bins(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """bin (from 0), n, mean_score, observed, gap over equal widths of the score."""
    b = F.least(F.floor(q(score) * bins), F.lit(bins - 1)).cast("int")
    per = df.where(q(score).isNotNull() & q(label).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(q(score)).alias("mean_score"), F.avg((q(label) == 1).cast("double")).alias("observed"))
    return per.withColumn("gap", F.abs(F.col("mean_score") - F.col("observed")))


def calibration_error(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """ece: gaps weighted by the bins' rows."""
    return calibration_bins(df, label, score, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def regression_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """n, mae, rmse, median_ae, r2, rmsle, mape; the last two over rows where they are defined."""
    y, p = q(label).cast("double"), q(predicted).cast("double")
    e = p - y
    log_ok = (y > -1) & (p > -1)
    rows = df.where(y.isNotNull() & p.isNotNull())
    got = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"),
        F.sqrt(F.avg(F.when(log_ok, F.pow(F.log1p(p) - F.log1p(y), 2)))).alias("rmsle"), F.avg(F.when(y != 0, F.abs(e / F.when(y != 0, y)))).alias("mape"),
    )
    middle = quantiles(rows, {"e": F.abs(e)}, [0.5])["e"][0]
    return got.select("n", "mae", "rmse", F.lit(middle).cast("double").alias("median_ae"), (1 - F.try_divide("sse", "sst")).alias("r2"), "rmsle", "mape")


def forecast_metrics(df: DataFrame, entity: str, time: str, key: str, value: str, season: int = 1) -> DataFrame:
    """n, mase, rmsse, smape of the seasonal naive forecast, scaled by the one-step errors of each entity's history."""
    w = Window.partitionBy(q(entity)).orderBy(q(time), q(key))
    y = q(value)
    rows = df.select(q(entity).alias("e"), y.alias("y"), F.lag(y, season).over(w).alias("f"), F.lag(y, 1).over(w).alias("one"))
    per = rows.groupBy("e").agg(F.count("f").alias("n"), F.avg(F.abs(F.col("y") - F.col("f"))).alias("mae"), F.avg(F.pow(F.col("y") - F.col("f"), 2)).alias("mse"), F.avg(F.abs(F.col("y") - F.col("one"))).alias("scale"), F.avg(F.pow(F.col("y") - F.col("one"), 2)).alias("scale2"), F.avg(F.coalesce(F.try_divide(2 * F.abs(F.col("y") - F.col("f")), F.abs("y") + F.abs("f")), F.when(F.col("f").isNotNull(), F.lit(0.0)))).alias("smape"))
    return per.agg(F.sum("n").alias("n"), F.avg(F.try_divide("mae", "scale")).alias("mase"), F.avg(F.sqrt(F.try_divide("mse", "scale2"))).alias("rmsse"), F.avg("smape").alias("smape"))


def interval_metrics(df: DataFrame, label: str, low: str, high: str, level: float) -> DataFrame:
    """n, coverage, mean_width, pinball_low, pinball_high of a central interval of the given level."""
    y, a, b = q(label), q(low), q(high)
    tail = (1 - level) / 2
    pin = lambda p, t: F.avg(F.when(y >= p, (y - p) * t).otherwise((p - y) * (1 - t)))
    return df.agg(F.count(y).alias("n"), F.avg(((y >= a) & (y <= b)).cast("double")).alias("coverage"), F.avg(b - a).alias("mean_width"), pin(a, tail).alias("pinball_low"), pin(b, 1 - tail).alias("pinball_high"))


def slice_metrics(df: DataFrame, slices: list[str], error: Column) -> DataFrame:
    """slice, value, n, mean_error for each value of each column and all rows (null slice), by grouping sets in one pass."""
    names = [f"s{i}" for i in range(len(slices))]
    rows = df.select(*[q(c).cast("string").alias(n) for c, n in zip(slices, names, strict=True)], error.alias("e"))
    sets = [[F.col(n)] for n in names] + [[]]
    got = rows.groupingSets(sets, *names).agg(F.count("e").alias("n"), F.avg("e").alias("mean_error"), F.grouping_id().alias("g"))
    which = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    every = (1 << len(names)) - 1
    for i, c in enumerate(slices):
        here = F.col("g") == (every ^ (1 << (len(names) - 1 - i)))
        which, value = F.when(here, F.lit(c)).otherwise(which), F.when(here, F.col(names[i])).otherwise(value)
    return got.select(which.alias("slice"), value.alias("value"), "n", "mean_error")


def bootstrap_mean(df: DataFrame, cluster: str, value: str, replicates: int = 50, seed: int = 7) -> DataFrame:
    """replicate, weight, mean under Poisson(1) weights per cluster, from md5(seed|cluster|replicate): one pass, repeatable.

    Values are summed by cluster first, so replicates multiply clusters, not rows.
    """
    per = df.where(q(value).isNotNull()).groupBy(q(cluster).cast("string").alias("c")).agg(F.sum(q(value)).alias("s"), F.count(F.lit(1)).alias("n"))
    each = per.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = hash_fold(F.concat_ws("|", "c", F.col("replicate").cast("string")), 1_000_000, seed) / F.lit(1_000_000.0)
    # The Poisson(1) distribution function at 0 to 6.
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
    got = each.withColumn("w", weight).groupBy("replicate").agg(F.sum(F.col("w") * F.col("n")).alias("weight"), F.sum(F.col("w") * F.col("s")).alias("ws"))
    return got.select("replicate", "weight", F.try_divide("ws", "weight").alias("mean"))


def bootstrap_interval(df: DataFrame, cluster: str, value: str, replicates: int = 50, seed: int = 7, level: float = 0.95) -> DataFrame:
    """low, median, high of the replicates' means."""
    tail = (1 - level) / 2
    means = bootstrap_mean(df, cluster, value, replicates, seed)
    return means.agg(*[F.percentile("mean", F.lit(p)).alias(n) for p, n in ((tail, "low"), (0.5, "median"), (1 - tail, "high"))])


def fold_variation(df: DataFrame, fold: str, value: str) -> DataFrame:
    """n_folds, mean, std, min, max of the folds' means."""
    per = df.groupBy(q(fold)).agg(F.avg(q(value)).alias("m"))
    return per.agg(F.count("m").alias("n_folds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.min("m").alias("min"), F.max("m").alias("max"))


def effective_sample_size(df: DataFrame, weight: str) -> DataFrame:
    """n, total, ess: (sum w)^2 / sum w^2."""
    w = q(weight).cast("double")
    return df.agg(F.count(w).alias("n"), F.sum(w).alias("total"), F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("ess"))


def drift(df: DataFrame, part: Column, columns: list[str]) -> DataFrame:
    """column_name, mean_a, mean_b, smd, missing_a, missing_b, out_of_range: part b (true) against part a (false)."""
    aggs = []
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        a, b = F.when(~part, x), F.when(part, x)
        aggs.append(F.struct(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count_if(~part & x.isNull()).alias("na"), F.count_if(part & x.isNull()).alias("nb"), F.min(a).alias("lo"), F.max(a).alias("hi")).alias(f"c{i}"))
    first = df.agg(*aggs).first()
    beyond = [F.count_if(part & ((q(c) < first[f"c{i}"]["lo"]) | (q(c) > first[f"c{i}"]["hi"]))).alias(f"o{i}") for i, c in enumerate(columns)]
    second = df.agg(*beyond).first()
    rows = []
    for i, c in enumerate(columns):
        s = first[f"c{i}"]
        pooled = (((s["va"] or 0) + (s["vb"] or 0)) / 2) ** 0.5
        rows.append((c, s["ma"], s["mb"], (s["mb"] - s["ma"]) / pooled if pooled and s["ma"] is not None and s["mb"] is not None else None, s["na"], s["nb"], second[f"o{i}"]))
    return df.sparkSession.createDataFrame(rows, "column_name string, mean_a double, mean_b double, smd double, missing_a long, missing_b long, out_of_range long")


def unseen_categories(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """value, n: values of df that the training rows don't hold."""
    seen = train.select(q(column).alias("_v")).distinct()
    new = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return new.join(seen, F.col("value") == F.col("_v"), "left_anti")


def expected_cost(df: DataFrame, label: str, predicted: str, false_positive: float, false_negative: float) -> DataFrame:
    """n, expected_cost per row."""
    y, p = q(label) == 1, q(predicted) == 1
    cost = F.when(p & ~y, F.lit(false_positive)).when(~p & y, F.lit(false_negative)).otherwise(F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(cost).alias("expected_cost"))


def best_score(df: DataFrame, name: str, score: str, higher_is_better: bool = True) -> DataFrame:
    """best_name, best_score; equal scores go to the first name."""
    best = (F.max if higher_is_better else F.min)(q(score))
    top = df.crossJoin(F.broadcast(df.agg(best.alias("_best")))).where(q(score) == F.col("_best"))
    return top.agg(F.min(q(name)).alias("best_name"), F.min("_best").alias("best_score"))


def ablation_delta(reference: DataFrame, ablated: DataFrame, key: str, score: str) -> DataFrame:
    """n_paired, delta: ablated less reference over the same row ids."""
    a, b = reference.select(q(key).alias("k"), q(score).alias("x")), ablated.select(q(key).alias("k"), q(score).alias("y"))
    return a.join(b, "k").agg(F.count(F.lit(1)).alias("n_paired"), (F.avg("y") - F.avg("x")).alias("delta"))


def permutation_test(df: DataFrame, key: str, block: str, label: str, value: str, permutations: int = 20, seed: int = 7) -> DataFrame:
    """n, difference, p_value: mean of label 1 less that of 0 against labels shuffled within blocks, with the +1 correction.

    In permutation b the labels of a block, in order of the key, go to its rows in order of md5(seed|b|key).
    """
    rows = df.select(q(key).alias("k"), q(block).alias("g"), (q(label) == 1).cast("int").alias("y"), q(value).cast("double").alias("v"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    each = rows.select("g", "k", "v", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("b"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("k").cast("string")).cast("binary"))
    dealt = each.withColumn("i", F.row_number().over(Window.partitionBy("g", "b").orderBy(order, "k")))
    shuffled = dealt.join(numbered.select("g", "i", "y"), ["g", "i"])
    gap = F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))
    real = rows.agg(F.count(F.lit(1)).alias("n"), gap.alias("difference"))
    drawn = shuffled.groupBy("b").agg(gap.alias("d"))
    both = drawn.crossJoin(F.broadcast(real))
    return both.groupBy("n", "difference").agg(((1 + F.count_if(F.abs("d") >= F.abs("difference"))) / F.lit(permutations + 1)).alias("p_value"))


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """n, median, p95 of a measure, exact."""
    middle, high = quantiles(df, {"x": q(value).cast("double")}, [0.5, 0.95])["x"]
    return df.agg(F.count(q(value)).alias("n")).select("n", F.lit(middle).cast("double").alias("median"), F.lit(high).cast("double").alias("p95"))
