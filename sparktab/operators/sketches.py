"""A store of mergeable sketches: distinct counts and quantiles of any union of partitions without another look at the rows.

Every answer is approximate and says so; the bounds are those of the sketches' sizes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import q

#: Binary logarithm of the buckets of a distinct-count sketch, size of a quantile sketch.
LOG_BUCKETS, QUANTILE_SIZE = 14, 400
#: Errors that they stay within with a chance above 0.99: three standard errors of 2**LOG_BUCKETS buckets, rank error of the size.
DISTINCT_ERROR, RANK_ERROR = 0.025, 0.012


def build(df: DataFrame, keys: list[str], distinct: list[str], numbers: list[str]) -> DataFrame:
    """keys, column_name, n, n_values, distinct_sketch, quantile_sketch: one row for each part and column.

    One aggregate whose sketches merge map-side; of numbers both sketches are kept, of other columns the first alone. Nulls
    count in n only. Write the rows partitioned by the keys; new parts are appended and never rebuild old ones.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    names = [*distinct, *(c for c in numbers if c not in distinct)]
    for i, c in enumerate(names):
        x = q(c).cast("double")
        text = q(c).cast("string")
        usable = F.when(~F.isnan(x), x) if c in numbers else F.lit(None).cast("double")
        aggs += [F.count(q(c)).alias(f"_v{i}"), F.hll_sketch_agg(text, F.lit(LOG_BUCKETS)).alias(f"_d{i}"), F.kll_sketch_agg_double(usable, F.lit(QUANTILE_SIZE)).alias(f"_q{i}")]
    per = df.groupBy(*[q(k).alias(k) for k in keys]).agg(*aggs)
    none = F.lit(None).cast("binary")
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_v{i}").alias("n_values"), F.col(f"_d{i}").alias("distinct_sketch"), (F.col(f"_q{i}") if c in numbers else none).alias("quantile_sketch")) for i, c in enumerate(names)])
    return per.select(*map(q, keys), F.col("_n").alias("n"), F.explode(rows).alias("_s")).select(*map(q, keys), "n", "_s.*")


def answer(store: DataFrame, by: list[str] = (), at: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """by, column_name, n, n_values, n_distinct, q<percent> ..., is_approx: the store's rows merged for each value of by.

    Filter the store first for a subset; quantiles of columns without a quantile sketch are null.
    """
    merged = store.groupBy(*[q(k) for k in by], "column_name").agg(
        F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("quantile_sketch").alias("_q")
    )
    has = F.col("_q").isNotNull() & (F.kll_sketch_get_n_double("_q") > 0)
    points = [F.when(has, F.kll_sketch_get_quantile_double("_q", F.lit(float(p)))).alias(f"q{round(100 * p)}") for p in at]
    return merged.select(*[q(k) for k in by], "column_name", "n", "n_values", F.hll_sketch_estimate("_d").alias("n_distinct"), *points, F.lit(True).alias("is_approx"))


def measured(df: DataFrame, answers: DataFrame, by: list[str], distinct: list[str], numbers: list[str], at: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """by, column_name, distinct_holds, quantiles_hold: whether the answers lie within the stated errors of exact ones.

    The exact side counts distinct values by grouping, and the rows at or below each answered quantile; it is what an audit
    of a store runs, not what its users do.
    """
    out = []
    for c in [*distinct, *(n for n in numbers if n not in distinct)]:
        mine = answers.where(F.col("column_name") == c)
        rows = df.select(*[q(k).alias(k) for k in by], q(c).alias("_c")).where("_c IS NOT NULL")
        exact = rows.distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_e"))
        both = mine.join(exact, by) if by else mine.crossJoin(exact)
        holds = (F.abs(F.col("n_distinct") - F.col("_e")) <= F.greatest(F.lit(1.0), F.col("_e") * DISTINCT_ERROR)).alias("distinct_holds")
        columns = [*[q(k) for k in by], "column_name"]
        if c not in numbers:
            out.append(both.select(*columns, holds, F.lit(None).cast("boolean").alias("quantiles_hold")))
            continue
        names = [f"q{round(100 * p)}" for p in at]
        cut = both.select(*columns, "n_values", holds, *names)
        joined = rows.join(F.broadcast(cut), by) if by else rows.crossJoin(F.broadcast(cut))  # a row for each value of by
        # the wanted rank lies between the shares below, and at or below, an answered quantile, give or take the error
        inside = [(F.avg((F.col("_c") < F.col(n)).cast("double")) <= p + RANK_ERROR) & (F.avg((F.col("_c") <= F.col(n)).cast("double")) >= p - RANK_ERROR) for n, p in zip(names, at, strict=True)]
        out.append(joined.groupBy(*columns, "distinct_holds").agg(functools.reduce(Column.__and__, inside).alias("quantiles_hold")))
    return functools.reduce(DataFrame.unionByName, out)
