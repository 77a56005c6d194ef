"""Stacking of out-of-fold predictions by a simple regularised second model, fitted on aggregated sums.

The second model never sees the fold that it scores: sums are taken per fold, and a fold's weights come from the others' sums.
Rows take their fold's number, 0 to k - 1; -1 stands for the weights of all rows, which new data get.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models
from .profile import q

ALL = -1


def out_of_fold_matrix(df: DataFrame, target: str, numbers: list[str], fold: str, k: int, families: list[str]) -> DataFrame:
    """df with a column p_<family> for each family: predictions by models that never saw the row's fold.

    The probability of the second class where a family has one. Configurations are fixed beforehand: nothing is tuned here.
    """
    for family in families:
        got = models.out_of_fold(df, target, numbers, fold, k, family)
        value = F.coalesce(F.col("probability"), F.col("prediction")) if "probability" in got.columns else F.col("prediction")
        df = got.select(*map(q, df.columns), value.alias(f"p_{family}"))
    return df


def nonnegative_least_squares(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The w >= 0 that minimises w'Gw / 2 - c'w, by an active set: models enter by steepest gradient and leave at zero."""
    k = len(cross)
    w, inside = np.zeros(k), np.zeros(k, bool)
    tolerance = 1e-12 * max(1.0, float(np.abs(cross).max(initial=0.0)))
    for _ in range(10 * k + 10):
        gradient = cross - gram @ w
        free = ~inside & (gradient > tolerance)
        if not free.any():
            break
        inside[np.argmax(np.where(free, gradient, -np.inf))] = True
        while True:
            full = np.zeros(k)
            full[inside] = np.linalg.lstsq(gram[np.ix_(inside, inside)], cross[inside], rcond=None)[0]
            low = inside & (full <= 0)
            if not low.any():
                w = full
                break
            steps = w[low] / np.maximum(w[low] - full[low], 1e-300)
            w = w + float(steps.min()) * (full - w)
            inside &= w > 1e-15
            w[~inside] = 0.0
            if not inside.any():
                break
    return w


class NonNegative:
    """Weights >= 0 of predictions by least squares of a number or a probability, nested in folds; one aggregate in all.

    Rows with a null target or prediction are left out of the fit.
    """

    def __init__(self, df: DataFrame, target: str, predictions: list[str], fold: str):
        self.predictions, self.fold = predictions, fold
        k = len(predictions)
        p = [q(c).cast("double") for c in predictions]
        y = q(target).cast("double")
        whole = y.isNotNull()
        for c in p:
            whole &= c.isNotNull()
        sums = [F.sum(p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(p[i] * y).alias(f"c{i}") for i in range(k)]
        rows = df.where(whole).groupBy(q(fold).cast("int").alias("fold")).agg(*sums).collect()  # one row a fold
        per = {r["fold"]: (np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), np.array([r[f"c{i}"] for i in range(k)])) for r in rows}
        gram, cross = sum((g for g, _ in per.values()), np.zeros((k, k))), sum((c for _, c in per.values()), np.zeros(k))
        self.sums = {ALL: (gram, cross)} | {f: (gram - g, cross - c) for f, (g, c) in per.items() if f is not None}
        self.weights = {f: nonnegative_least_squares(g, c) for f, (g, c) in self.sums.items()}

    def conditions(self, df: DataFrame) -> DataFrame:
        """fold, model, weight, slack, holds: slack is the gradient (0 for a model in use, not below 0 for one left out)."""
        rows = []
        for f, w in sorted(self.weights.items()):
            g, c = self.sums[f]
            slack, scale = g @ w - c, max(1.0, float(np.abs(c).max(initial=0.0)))
            rows += [(f, m, float(w[i]), float(slack[i]), bool(w[i] >= 0 and slack[i] >= -1e-9 * scale and abs(w[i] * slack[i]) <= 1e-9 * scale)) for i, m in enumerate(self.predictions)]
        return df.sparkSession.createDataFrame(rows, "fold int, model string, weight double, slack double, holds boolean")

    def score(self, df: DataFrame, out: str = "stacked") -> DataFrame:
        """df with the weighted prediction by its own fold's weights; rows of an unknown fold by those of all rows."""
        mixed = lambda w: sum((F.lit(float(x)) * q(c) for x, c in zip(w, self.predictions, strict=True)), F.lit(0.0))
        return df.withColumn(out, _by_fold(self.fold, {f: mixed(w) for f, w in self.weights.items()}))


def _by_fold(fold: str, values: dict[int, Column]) -> Column:
    out = values[ALL]
    for f, value in values.items():
        out = F.when(q(fold) == f, value).otherwise(out) if f != ALL else out
    return out


def log_odds(p: Column) -> Column:
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p.cast("double")))
    return F.log(clipped / (1 - clipped))


class RidgeLogistic:
    """A logistic model of the predictions' log-odds with an L2 penalty, nested in folds.

    Newton's steps on aggregated gradients and Hessians: one aggregate a step for all folds at once. A row counts for each
    fold but its own, so rows are expanded by the number of folds before the partial aggregate, never shuffled so.
    """

    def __init__(self, df: DataFrame, target: str, predictions: list[str], fold: str, folds: int, penalty: float = 1.0, steps: int = 25, intercept: bool = True):
        self.predictions, self.fold, self.intercept = predictions, fold, intercept
        x = [log_odds(q(c)) for c in predictions] + ([F.lit(1.0)] if intercept else [])
        k = len(x)
        y = (q(target) == 1).cast("double")
        rows = df.select(q(fold).cast("int").alias("f"), y.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).na.drop(subset=["y", *[f"x{i}" for i in range(k)]])
        rows = rows.withColumn("outer", F.explode(F.array(*[F.lit(f) for f in (ALL, *range(folds))]))).where(F.coalesce(F.col("f") != F.col("outer"), F.lit(True)))
        self.weights = {f: np.zeros(k) for f in (ALL, *range(folds))}
        ridge = np.full(k, penalty)
        if intercept:
            ridge[-1] = 0.0
        self.steps = 0
        for _ in range(steps):
            score = F.lit(0.0)
            for f, w in self.weights.items():
                score = F.when(F.col("outer") == f, sum((F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(w)), F.lit(0.0))).otherwise(score)
            p = 1 / (1 + F.exp(-score))
            held = rows.withColumn("p", p).withColumn("v", F.col("p") * (1 - F.col("p")))
            sums = [F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")).alias(f"d{i}") for i in range(k)] + [F.sum(F.col("v") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
            moved = 0.0
            for r in held.groupBy("outer").agg(*sums).collect():  # one row a fold
                w = self.weights[r["outer"]]
                hessian = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag(ridge)
                step = np.linalg.lstsq(hessian, np.array([r[f"d{i}"] for i in range(k)]) - ridge * w, rcond=None)[0]
                self.weights[r["outer"]] = w + step
                moved = max(moved, float(np.abs(step).max()))
            self.steps += 1
            if moved < 1e-10:
                break

    def score(self, df: DataFrame, out: str = "stacked") -> DataFrame:
        """df with the probability by its own fold's model."""
        def value(w: np.ndarray) -> Column:
            xs = [log_odds(q(c)) for c in self.predictions] + ([F.lit(1.0)] if self.intercept else [])
            return 1 / (1 + F.exp(-sum((F.lit(float(v)) * x for v, x in zip(w, xs, strict=True)), F.lit(0.0))))

        return df.withColumn(out, _by_fold(self.fold, {f: value(w) for f, w in self.weights.items()}))
