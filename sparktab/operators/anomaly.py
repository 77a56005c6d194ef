"""Anomaly scores: isolation forest, local outlier factor and robust covariance, all as DataFrame plans.

Rows with a null or non-finite value in any of the columns are neither fitted nor scored: their score is null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..sources.staging import staged
from .profile import q
from .ranks import ACCURACY, FEW, brackets

#: Rows that a forest's trees are drawn from, and that robust covariance tries its starts on. Documented bounds of samples.
POOL, TRIALS = 16_384, 1_500
#: Concentration steps of every start on the trial rows.
TRIAL_STEPS = 5
#: Robust covariance stops when no moment moves by more than this share of its scale, and takes cuts that moved by at most
#: half of NEAR_CUT as brackets of the next.
STILL, NEAR_CUT = 1e-12, 1e-3
#: Rows that a cell of the neighbour search holds on average, and cells at most.
CELL_ROWS, CELLS = 256, 4_096


def _draw(seed: int, *parts: Column) -> Column:
    """The first 32 bits of md5(seed|parts) as a number in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def _points(columns: list[str]) -> Column:
    """The columns as an array of finite doubles, or null."""
    xs = [finite(q(c)) for c in columns]
    whole = xs[0].isNotNull()
    for x in xs[1:]:
        whole &= x.isNotNull()
    return F.when(whole, F.array(*xs))


# isolation forest


def path_length(n: Column) -> Column:
    """The mean depth at which a random search tree of n rows isolates one."""
    x = n.cast("double")
    return F.when(n > 2, 2 * (F.log(x - 1) + F.lit(0.5772156649)) - 2 * (x - 1) / x).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))


def forest(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 7) -> DataFrame:
    """tree, node, feature, cut, depth: random trees of ceil(log2(sample)) levels, grown level by level.

    Each tree takes the sample rows of smallest md5(seed|tree|key) of the POOL rows of smallest md5(seed|key), so what a
    tree sees is bounded and repeatable whatever the table. One aggregate a level gives the ranges of all nodes of all
    trees; a node is cut within the range of a feature that varies in it. Leaves have no feature, and depth adds the mean
    depth of a tree of their rows. Node numbers are those of a heap, from 1.
    """
    d = len(columns)
    rows = df.select(q(key).cast("string").alias("k"), _points(columns).alias("x")).where("x IS NOT NULL")
    digest = lambda *p: F.md5(F.concat_ws("|", F.lit(str(seed)), *p).cast("binary"))
    pool = rows.orderBy(digest("k"), "k", "x").limit(POOL)
    dealt = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    first = Window.partitionBy("tree").orderBy(digest(F.col("tree").cast("string"), "k"), "k", "x")
    at = dealt.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample).select("tree", "x", F.lit(1).alias("node"))
    at = staged(at)
    levels = math.ceil(math.log2(max(sample, 2)))
    grown = None
    for level in range(levels + 1):
        ranges = [F.struct(F.min(F.col("x")[i]).alias("lo"), F.max(F.col("x")[i]).alias("hi")) for i in range(d)]
        nodes = at.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.array(*ranges).alias("ranges"))
        varies = F.filter(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.col("ranges")[i]["hi"] > F.col("ranges")[i]["lo"])
        nodes = nodes.withColumn("varies", varies)
        pick = F.floor(_draw(seed, F.lit("feature"), F.col("tree"), F.col("node")) * F.size("varies")).cast("int")
        feature = F.when((F.size("varies") > 0) & F.lit(level < levels), F.get("varies", pick))
        nodes = nodes.withColumn("feature", feature).withColumn("range", F.get("ranges", F.col("feature")))
        cut = F.col("range.lo") + _draw(seed, F.lit("cut"), F.col("tree"), F.col("node")) * (F.col("range.hi") - F.col("range.lo"))
        nodes = nodes.select("tree", "node", "n", "feature", cut.alias("cut"))
        depth = F.when(F.col("feature").isNull(), F.lit(float(level)) + path_length(F.col("n")))
        made = nodes.select("tree", "node", "feature", "cut", depth.alias("depth"))
        grown = made if grown is None else grown.unionByName(made)
        inner = nodes.where("feature IS NOT NULL").select("tree", "node", "feature", "cut")
        right = (F.get("x", F.col("feature")) >= F.col("cut")).cast("int")
        at = staged(at.join(inner, ["tree", "node"]).select("tree", "x", (F.col("node") * 2 + right).alias("node")))  # else each level runs all before it
    return grown


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 7, out: str = "isolation_score") -> DataFrame:
    """df with a score in (0, 1), higher for rows that few random cuts isolate: 2 ** -(mean depth / expected depth).

    The forest, at most trees * 4 * sample nodes, is broadcast as arrays; every row walks it in the JVM.
    """
    levels = math.ceil(math.log2(max(sample, 2)))
    nodes = staged(forest(df, key, columns, trees, sample, seed))
    entry = F.struct("feature", "cut", "depth").alias("v")
    per = nodes.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct(F.col("node"), entry))).alias("m"))
    size = 2 ** (levels + 1)
    slots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at(F.col("m"), i.cast("int")))
    arrays = per.select(F.struct(F.col("tree"), slots.alias("nodes")).alias("t")).agg(F.array_sort(F.collect_list("t")).alias("_trees"))
    fitted = df.select(_points(columns).alias("x")).where("x IS NOT NULL").agg(F.least(F.count(F.lit(1)), F.lit(sample)).alias("_fitted"))
    point = F.col("_x")

    def depth(tree: Column) -> Column:
        step = lambda node, _: F.coalesce(node * 2 + (F.get(point, F.get(tree["nodes"], node)["feature"]) >= F.get(tree["nodes"], node)["cut"]).cast("int"), node)
        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), step)
        return F.get(tree["nodes"], leaf)["depth"]

    total = F.aggregate("_trees", F.lit(0.0), lambda a, t: a + depth(t))
    score = F.pow(F.lit(2.0), -F.try_divide(total / F.size("_trees"), path_length(F.col("_fitted"))))
    scored = df.withColumn("_x", _points(columns)).crossJoin(F.broadcast(arrays)).crossJoin(F.broadcast(fitted))  # one row each
    return scored.select(*map(q, df.columns), F.when(F.col("_x").isNotNull(), score).alias(out))


# local outlier factor


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def neighbours(points: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """p, o, d, m: for each distinct point p of points(x, m), every point o whose distance is at most that of p's k-th
    nearest other row; m rows lie at o. p itself stands in the list with its other m - 1 rows, at distance 0, if any.

    Points are dealt to the nearest of a bounded number of pivots. The k-th distance within a point's own cell bounds its
    true one, so it is sent only to cells that can hold a nearer point by the triangle inequality; no pair of cells further
    apart meets, and no cap is set on either.
    """
    total = points.count()
    cells = max(1, min(CELLS, -(-total // CELL_ROWS)))
    drawn = points.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("x").cast("string")).cast("binary"))).limit(cells)
    pivots = drawn.agg(F.collect_list("x").alias("pivots"))  # at most CELLS points
    near = F.array_min(F.transform("pivots", lambda v, i: F.struct(_distance(F.col("x"), v).alias("d"), i.alias("c"))))
    placed = staged(points.crossJoin(F.broadcast(pivots)).withColumn("near", near).select("x", "m", "near.c", F.col("near.d").alias("dp")))
    per = placed.groupBy("c").agg(F.max("dp").alias("u"), F.sum("m").alias("rows")).crossJoin(F.broadcast(pivots))
    tops = per.select(F.struct("c", F.col("pivots")[F.col("c")].alias("v"), "u", "rows").alias("t")).agg(F.collect_list("t").alias("tops"))
    # the k-th distance within the own cell; with fewer rows there, all cells within the sum of distances and radii
    own = placed.join(placed.select("c", F.col("x").alias("y"), F.col("m").alias("n")), "c")
    own = own.select("x", "m", "c", "y", _distance(F.col("x"), F.col("y")).alias("d"), F.when(F.col("x") == F.col("y"), F.col("n") - 1).otherwise(F.col("n")).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("x").orderBy("d"))
    bound = own.withColumn("upto", upto).groupBy("x", "m", "c").agg(F.min(F.when(F.col("upto") >= k, F.col("d"))).alias("bound"))
    sent = bound.crossJoin(F.broadcast(tops))  # one row, at most CELLS cells
    reach = F.array_sort(F.transform("tops", lambda t: F.struct((_distance(F.col("x"), t["v"]) + t["u"]).alias("far"), t["rows"].alias("rows"))))
    # the point itself is one of the rows counted
    loose = F.aggregate(reach, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("far")), lambda a, t: F.when(a["seen"] > k, a).otherwise(F.struct((a["seen"] + t["rows"]).alias("seen"), t["far"].alias("far"))))
    sent = sent.withColumn("bound", F.coalesce("bound", loose["far"]))
    visited = F.transform(F.filter("tops", lambda t: _distance(F.col("x"), t["v"]) - t["u"] <= F.col("bound") * (1 + 1e-12) + 1e-300), lambda t: t["c"])
    sent = sent.select("x", "m", "bound", F.explode(visited).alias("c"))
    pairs = sent.join(placed.select("c", F.col("x").alias("y"), F.col("m").alias("n")), "c").withColumn("d", _distance(F.col("x"), F.col("y")))
    pairs = pairs.where(F.col("d") <= F.col("bound")).select(F.col("x").alias("p"), F.col("y").alias("o"), "d", F.when(F.col("x") == F.col("y"), F.col("n") - 1).otherwise(F.col("n")).alias("m")).where("m > 0")
    upto = pairs.withColumn("upto", F.sum("m").over(Window.partitionBy("p").orderBy("d")))
    kth = F.min(F.when(F.col("upto") >= k, F.col("d"))).over(Window.partitionBy("p"))
    return upto.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("d") <= F.col("kth"))).select("p", "o", "d", "m", F.coalesce("kth", F.max("d").over(Window.partitionBy("p"))).alias("kth"))


def local_outlier_factors(df: DataFrame, columns: list[str], k: int = 20, out: str = "lof", seed: int = 7, dense: float = 1.0) -> DataFrame:
    """df with the local outlier factor of each row among its k nearest others (all at the k-th distance count).

    Rows equal in all columns are one point with a weight, so copies make no pairs. A density is infinite where k copies
    lie at one point: such rows have the factor dense (NaN is what dividing their densities gives), and rows with such a
    neighbour have an infinite one. Fewer than k other rows are all neighbours; a single row has none and null.
    """
    points = staged(df.select(_points(columns).alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("m")))
    near = staged(neighbours(points, k, seed))
    kth = near.select(F.col("p").alias("o"), F.col("kth").alias("ko")).distinct()
    density = near.join(kth, "o").groupBy("p").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.greatest("ko", "d")).alias("reach"))
    density = density.select("p", "n", F.when(F.col("reach") > 0, F.col("n") / F.col("reach")).otherwise(F.lit(float("inf"))).alias("lrd"))
    mean = near.join(density.select(F.col("p").alias("o"), F.col("lrd").alias("lo")), "o").groupBy("p").agg((F.sum(F.col("m") * F.col("lo")) / F.sum("m")).alias("mean"))
    factor = F.when(F.col("lrd") == float("inf"), F.lit(dense)).otherwise(F.col("mean") / F.col("lrd"))
    scored = density.join(mean, "p").select(F.col("p").alias("_p"), factor.alias(out))
    return df.withColumn("_x", _points(columns)).join(scored, F.col("_x") == F.col("_p"), "left").select(*map(q, df.columns), out)


# robust covariance


def _sums(x: list[Column], w: Column) -> dict[str, Column]:
    d = len(x)
    sums = {"w": w} | {f"s{i}": w * x[i] for i in range(d)} | {f"s{i}_{j}": w * x[i] * x[j] for i in range(d) for j in range(i, d)}
    return {name: F.sum(c).alias(name) for name, c in sums.items()}


def _moments(r, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a row of weighted sums."""
    mean = np.array([r[f"s{i}"] for i in range(d)]) / r["w"]
    second = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / r["w"]
    return mean, second - np.outer(mean, mean)


def _mahalanobis(x: list[Column], mean: np.ndarray, covariance: np.ndarray) -> Column:
    inverse = np.linalg.inv(covariance)
    d = len(mean)
    diff = [x[i] - F.lit(float(mean[i])) for i in range(d)]
    return sum((diff[i] * diff[j] * F.lit(float(inverse[i, j])) for i in range(d) for j in range(d)), F.lit(0.0))


class RobustCovariance:
    """Location and covariance of the half of the rows whose covariance has the smallest determinant that was found.

    FAST-MCD: starts of columns + 1 rows (smallest md5(seed|start|key)) are drawn from the TRIALS rows of smallest
    md5(seed|key) and take TRIAL_STEPS concentration steps there, each all starts at once; the best goes on over the whole table
    until its moments stand still. A step brackets the distance of rank h = (n + columns + 1) // 2, by the cut of the step before
    once cuts move little and by a sketch until then, and takes the moments of all rows below the bracket and of each distance
    in it in one aggregate. Rows tied at the cut share what is left of h evenly, so the determinant never rises. Starts of no
    volume are passed over. Sums are taken about the columns' means.
    """

    def __init__(self, df: DataFrame, key: str, columns: list[str], starts: int = 20, steps: int = 50, seed: int = 7):
        self.columns = columns
        d = len(columns)
        xs = [f"x{i}" for i in range(d)]
        rows = df.select(q(key).cast("string").alias("k"), *[finite(q(c)).alias(x) for c, x in zip(columns, xs, strict=True)]).na.drop(subset=xs)
        centre = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in xs]).first()
        self.n, self.h = centre["n"], (centre["n"] + d + 1) // 2
        self.determinants: list[float] = []
        self.location, self.covariance = np.full(d, np.nan), np.full((d, d), np.nan)
        if self.n <= d:
            return
        shift = np.array([centre[x] for x in xs])
        rows = rows.select("k", *[(F.col(x) - F.lit(float(m))).alias(x) for x, m in zip(xs, shift, strict=True)])
        points = [F.col(x) for x in xs]
        digest = lambda *p: F.md5(F.concat_ws("|", F.lit(str(seed)), *p).cast("binary"))
        trial = staged(rows.orderBy(digest("k"), "k", *xs).limit(TRIALS)).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
        per = Window.partitionBy("start")
        drawn = trial.withColumn("r", F.row_number().over(per.orderBy(digest(F.col("start").cast("string"), "k"), "k", *xs))).where(F.col("r") <= d + 1)
        fits = self._per_start(drawn.withColumn("weight", F.lit(1.0)), points)
        for _ in range(TRIAL_STEPS):
            if not fits:
                return
            # the distance by the fit of the row's own start; at most starts literals
            distance = F.lit(None).cast("double")
            for s, (mean, covariance) in fits.items():
                distance = F.when(F.col("start") == s, _mahalanobis(points, mean, covariance)).otherwise(distance)
            ranked = trial.withColumn("dist", distance).where("dist IS NOT NULL")
            below = F.rank().over(per.orderBy("dist")) - 1
            ties = F.count(F.lit(1)).over(Window.partitionBy("start", "dist"))
            h = F.floor((F.count(F.lit(1)).over(per) + d + 1) / 2)
            weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - below) / ties))
            fits = self._per_start(ranked.withColumn("weight", weight), points)
        if not fits:
            return
        best = min(fits, key=lambda s: (np.linalg.det(fits[s][1]), s))
        mean, covariance = fits[best]
        cuts: list[float] = []
        for _ in range(steps):
            near = self._nearest(rows.select(*xs, _mahalanobis(points, mean, covariance).alias("dist")), points, cuts)
            cuts.append(near["cut"])
            before = mean, covariance
            mean, covariance = _moments(near, d)
            determinant = float(np.linalg.det(covariance))
            self.determinants.append(determinant)
            # the determinant stands still before the rows do: those swapped at the cut are about equally far
            if not determinant > 0:
                break
            scale = np.sqrt(np.diag(covariance))
            if max((np.abs(mean - before[0]) / scale).max(), (np.abs(covariance - before[1]) / np.outer(scale, scale)).max()) <= STILL:
                break
        self.location, self.covariance = mean + shift, covariance

    def _nearest(self, rows: DataFrame, points: list[Column], cuts: list[float]) -> Row:
        """Sums over the h rows of smallest dist, and the largest of those as cut; cuts are those of the steps before."""
        moved = 2 * abs(cuts[-1] / cuts[-2] - 1) if len(cuts) > 1 and cuts[-2] > 0 else math.inf
        if moved <= NEAR_CUT:
            width = max(moved, NEAR_CUT / 100)
            near = self._within(rows, points, cuts[-1] * (1 - width), cuts[-1] * (1 + width))
            if near is not None:
                return near
        if self.n > FEW:
            p = (self.h - 1) / (self.n - 1)
            low, high = rows.agg(F.percentile_approx("dist", brackets(p), ACCURACY)).first()[0]
            near = self._within(rows, points, low, high)
            if near is not None:
                return near
        return self._within(rows, points, -math.inf, math.inf)

    def _within(self, rows: DataFrame, points: list[Column], low: float, high: float) -> Row | None:
        """_nearest by a bracket of the cut, or None if that lies elsewhere. Only the bracket's distances are ordered."""
        cell = F.when(F.col("dist") >= F.lit(low), F.col("dist")).alias("cell")
        sums = _sums(points, F.lit(1.0))
        cells = rows.where(F.col("dist") <= F.lit(high)).groupBy(cell).agg(*sums.values())
        upto = F.sum("w").over(Window.orderBy(F.col("cell").asc_nulls_first()))
        # all of a cell, what the cut leaves of it, or none
        cells = cells.withColumn("share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(self.h)) - upto + F.col("w")) / F.col("w"))))
        found = cells.agg(
            F.sum("w").alias("upto"), F.sum(F.when(F.col("cell").isNull(), F.col("w")).otherwise(0.0)).alias("below"), F.max(F.when(F.col("share") > 0, F.col("cell"))).alias("cut"),
            *[F.sum(F.col("share") * F.col(c)).alias(c) for c in sums],
        ).first()
        return found if found["upto"] is not None and found["below"] < self.h <= found["upto"] else None

    @staticmethod
    def _per_start(weighted: DataFrame, points: list[Column]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for r in weighted.groupBy("start").agg(*_sums(points, F.col("weight")).values()).collect():  # one row a start
            mean, covariance = _moments(r, len(points))
            if np.linalg.det(covariance) > 1e-12 * max(1e-300, float(np.prod(np.diag(covariance)))):
                out[r["start"]] = mean, covariance
        return out

    def distances(self, df: DataFrame, out: str = "robust_distance") -> DataFrame:
        """df with each row's Mahalanobis distance; null for all rows where no subset has a volume."""
        if not np.isfinite(self.covariance).all() or not np.linalg.det(self.covariance) > 0:
            return df.withColumn(out, F.lit(None).cast("double"))
        # a null in any column makes the sum null, and greatest would pass over it
        squared = _mahalanobis([finite(q(c)) for c in self.columns], self.location, self.covariance)
        return df.withColumn(out, F.sqrt(F.when(squared < 0, 0.0).otherwise(squared)))
