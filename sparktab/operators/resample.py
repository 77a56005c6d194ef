"""Resampling that reruns a review queue: paired differences of two scores under block and entity weights, with intervals.

Weights are Poisson(1) from md5(seed|kind|unit|replicate), so replicates repeat and need no state.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .profile import q
from .splits import hash_fold

#: Hash parts of a batch that are ranked apart, times its capacity that a batch's prefix first holds.
PARTS, AHEAD = 64, 4


def poisson_weight(seed: int, *parts: Column) -> Column:
    u = hash_fold(F.concat_ws("|", *[p.cast("string") for p in parts]), 1_000_000, seed) / F.lit(1_000_000.0)
    # The Poisson(1) distribution function at 0 to 6.
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0)).cast("long")


class QueueBootstrap:
    """Two scores' precision in a review queue, resampled with the whole queue policy rerun in every replicate.

    A batch's eligible rows (a score, a key) fill its capacity in order of the score, ties by key, with at most per_entity
    rows of an entity. Batches are resampled by blocks of neighbouring ones (`period`, an expression over the batch, names a
    row's block), and with two_way entities as well: an entity drawn w times stands w times in each of its batches, each
    with its own cap, and the queue fills anew. Both scores meet the same weights, so their difference is paired.

    Only a prefix of a batch can fill its queue. It begins with AHEAD times the capacity and is doubled for as long as a
    replicate runs short in a batch that has more rows, so no row that a queue needs is left out, and rows x replicates are
    made of prefixes only. Rows without label are eligible and count as no event.
    """

    def __init__(self, df: DataFrame, batch: str, period: Column, entity: str, key: str, label: str, scores: tuple[str, str], capacity: int, per_entity: int, replicates: int = 50, two_way: bool = True, seed: int = 7):
        self.capacity, self.replicates, self.two_way, self.seed = capacity, replicates, two_way, seed
        y = F.coalesce((q(label) == 1).cast("long"), F.lit(0))
        rows = df.select(q(batch).cast("string").alias("batch"), period.cast("string").alias("period"), q(entity).cast("string").alias("entity"), q(key).alias("k"), y.alias("y"), *[q(s).cast("double").alias(f"s{i}") for i, s in enumerate(scores)])
        self.sums = staged(self._replayed(rows, 0, per_entity).unionByName(self._replayed(rows, 1, per_entity)))

    def _ranked(self, rows: DataFrame, score: str, per_entity: int, upto: int) -> DataFrame:
        """The first upto rows of each batch after the cap, with their place."""
        order = [F.desc(score), "k"]
        own = Window.partitionBy("batch", "entity")
        rows = rows.where(F.col(score).isNotNull())
        # parts first: an entity, or a batch, may hold a third of all rows
        part = F.pmod(F.xxhash64("k"), F.lit(PARTS))
        for by in (Window.partitionBy("batch", "entity", part), own):
            rows = rows.withColumn("e", F.row_number().over(by.orderBy(*order))).where(F.col("e") <= per_entity)
        for by in (Window.partitionBy("batch", part), Window.partitionBy("batch")):
            rows = rows.withColumn("place", F.row_number().over(by.orderBy(*order))).where(F.col("place") <= upto)
        return rows

    def _replayed(self, rows: DataFrame, which: int, per_entity: int) -> DataFrame:
        """replicate (-1: the table itself), period, batches' taken rows and hits, of one score."""
        upto = self.capacity * AHEAD
        while True:
            first = staged(self._ranked(rows, f"s{which}", per_entity, upto + 1).select("batch", "period", "entity", "k", "y", "place"))
            prefix = first.where(F.col("place") <= upto)
            each = prefix.withColumn("replicate", F.explode(F.sequence(F.lit(-1), F.lit(self.replicates - 1))))
            drawn = poisson_weight(self.seed, F.lit("entity"), F.col("entity"), F.col("replicate")) if self.two_way else F.lit(1).cast("long")
            each = each.withColumn("w", F.when(F.col("replicate") < 0, F.lit(1)).otherwise(drawn))
            before = F.coalesce(F.sum("w").over(Window.partitionBy("replicate", "batch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            taken = F.greatest(F.lit(0), F.least(F.col("w"), F.lit(self.capacity) - before))
            filled = staged(each.withColumn("taken", taken).groupBy("replicate", "batch", "period").agg(F.sum("taken").alias("taken"), F.sum(F.col("taken") * F.col("y")).alias("hits")))
            more = first.where(F.col("place") > upto).select("batch").distinct()
            if not filled.where(F.col("taken") < self.capacity).join(more, "batch", "left_semi").limit(1).count():
                break
            upto *= 2
        return filled.groupBy("replicate", "period").agg(F.sum("taken").alias("taken"), F.sum("hits").alias("hits")).withColumn("score", F.lit(which))

    def _rates(self, sums: DataFrame, *by: str) -> DataFrame:
        rate = lambda i: F.try_divide(F.sum(F.when(F.col("score") == i, F.col("w") * F.col("hits"))).cast("double"), F.sum(F.when(F.col("score") == i, F.col("w") * F.col("taken"))))
        return sums.groupBy(*by).agg(rate(0).alias("a"), rate(1).alias("b")).withColumn("difference", F.col("b") - F.col("a"))

    def draws(self) -> DataFrame:
        """replicate, a, b, difference: precision of both queues under the replicate's weights."""
        w = poisson_weight(self.seed, F.lit("period"), F.col("period"), F.col("replicate"))
        return self._rates(self.sums.where("replicate >= 0").withColumn("w", w), "replicate")

    def interval(self, level: float = 0.95) -> DataFrame:
        """n_periods, a, b, difference, low, high, below, acceleration, bca_low, bca_high in one row.

        low and high are percentiles of the replicates' differences. The corrected ones shift them by how many replicates lie
        below the estimate and by the skew of leaving each period out, which takes the periods' sums alone; they are null
        where all or none lie below.
        """
        real = self.sums.where("replicate < 0").withColumn("w", F.lit(1))
        totals = real.groupBy("score").agg(F.sum("taken").alias("all_taken"), F.sum("hits").alias("all_hits"))
        left = real.join(F.broadcast(totals), "score")  # two rows
        left = left.select("score", "period", "w", (F.col("all_taken") - F.col("taken")).alias("taken"), (F.col("all_hits") - F.col("hits")).alias("hits"))
        out = self._rates(left, "period").where("difference IS NOT NULL")
        moments = out.agg(F.count(F.lit(1)).alias("n"), F.sum("difference").alias("s1"), F.sum(F.pow("difference", F.lit(2.0))).alias("s2"), F.sum(F.pow("difference", F.lit(3.0))).alias("s3")).first()
        estimate = self._rates(real).first()
        draws = self.draws().where("difference IS NOT NULL")
        tail = (1 - level) / 2
        # as many numbers as replicates, a parameter
        got = draws.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("difference") < F.lit(estimate["difference"])).alias("below"), F.percentile("difference", F.array(F.lit(tail), F.lit(1 - tail))).alias("p")).first()
        n, mean = moments["n"], moments["s1"] / moments["n"] if moments["n"] else 0.0
        second = (moments["s2"] or 0.0) - n * mean * mean
        third = n * mean**3 * 2 - 3 * mean * (moments["s2"] or 0.0) + (moments["s3"] or 0.0)
        acceleration = -third / (6 * second**1.5) if second > 1e-300 else 0.0
        low, high = got["p"] or (None, None)
        ends = [None, None]
        if got["n"] and 0 < got["below"] < got["n"]:
            normal = NormalDist()
            z0 = normal.inv_cdf(got["below"] / got["n"])
            zs = [z0 + normal.inv_cdf(p) for p in (tail, 1 - tail)]
            at = [normal.cdf(z0 + z / (1 - acceleration * z)) for z in zs]
            ends = draws.agg(F.percentile("difference", F.array(*map(F.lit, at))).alias("p")).first()["p"]
        row = (n, estimate["a"], estimate["b"], estimate["difference"], low, high, got["below"] / got["n"] if got["n"] else None, acceleration, *ends)
        names = ["n_periods long", *[f"{c} double" for c in ("a", "b", "difference", "low", "high", "below", "acceleration", "bca_low", "bca_high")]]
        return self.sums.sparkSession.createDataFrame([row], ", ".join(names))
