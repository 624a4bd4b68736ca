"""Regimes of units: clustering, its scores, representatives and shapes (F). Vectors are array<double> columns `v`."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import components
from ..sources.tables import stored
from .clean import drop_constant, impute_mean


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scaled(df: DataFrame, cols: list[str], key: str = "unit") -> DataFrame:
    """key, v: columns with means for what is missing, without constant ones, scaled to deviation 1."""
    d = drop_constant(impute_mean(df.select(key, *cols), cols), cols)
    kept = [c for c in d.columns if c != key]
    s = d.agg(*[x for c in kept for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    d = d.crossJoin(F.broadcast(s))  # one row
    return d.select(key, F.array(*[(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in kept]).alias("v"))


def cluster_regimes(vectors: DataFrame, k: int, seed: int, bisecting: bool = False) -> DataFrame:
    """vectors with `cluster`."""
    d = vectors.withColumn("features", array_to_vector("v"))
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(d)
    return model.transform(d).drop("features")


def silhouette(df: DataFrame, label: str = "label", key: str = "unit") -> DataFrame:
    """One row: the mean silhouette by squared Euclidean distance. A point's mean distance to a cluster follows from the
    cluster's mean vector and mean square, so the work is points by clusters. Alone in a cluster: 0."""
    long = df.select(key, label, F.posexplode("v").alias("i", "x"))
    mean = long.groupBy(label, "i").agg(F.avg("x").alias("m")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(square).alias("sq")).join(mean, label).select(F.col(label).alias("other"), "n", "sq", "mean")
    d = df.select(key, label, "v", square.alias("own")).crossJoin(F.broadcast(c))  # clusters are few
    dot = F.aggregate(F.zip_with("v", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("d", F.col("own") + F.col("sq") - 2 * dot)
    inside = F.col("other") == F.col(label)
    d = d.groupBy(key).agg(F.max(F.when(inside, F.when(F.col("n") > 1, F.col("d") * F.col("n") / (F.col("n") - 1)))).alias("a"), F.min(F.when(~inside, F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("silhouette"))


BLOCK, WIDE = 1024, 16  # units of a block, and how many times that a block has where blocks would be over 8


def _sums(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of the distances of each x to the y of each label (of: a column for each label), in tiles that stay in a core's cache."""
    total = np.zeros((len(x), of.shape[1]))
    for at in range(0, len(y), 1024):
        some, label = y[at : at + 1024], of[at : at + 1024]
        turned, square = np.ascontiguousarray(-2 * some.T), (some**2).sum(1)
        for i in range(0, len(x), 64):
            part = x[i : i + 64]
            own = (part**2).sum(1)
            far = part @ turned
            far += own[:, None]
            far += square
            least = 1e-4 * (own + square.max())
            for p in np.flatnonzero(far.min(1) < least):
                q = np.flatnonzero(far[p] < least[p])
                far[p, q] = ((part[p] - some[q]) ** 2).sum(1)
            total[i : i + 64] += np.sqrt(far, out=far) @ label
    return total


def distance_sums(df: DataFrame, label: str = "label", key: str = "unit", within: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """key, label, other, total, n: number and sum of Euclidean distances of each unit, or of those in asked (key), to the
    other units of each label, or of its own label only (`within`).

    These sums are over all pairs by definition. Units are dealt into blocks of BLOCK to WIDE * BLOCK; each two blocks (of
    one label, if `within`) meet in a task of their own and give a row for each unit and label, so no label is gathered in
    a task, however many units it has; a vector is sent once for each block that it meets. Distances come from products
    of matrices; those that are small beside the vectors, where that loses digits, from differences.
    """
    scope = F.col(label) if within else F.lit(0)
    d = df.select(F.col(key).alias("x"), F.col(label).alias("lx"), "v", scope.alias("scope"))
    sizes = d.groupBy(F.col("scope").alias("of")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / (WIDE * BLOCK)), F.least(F.lit(8), F.ceil(F.count(F.lit(1)) / BLOCK))).cast("long").alias("blocks"))
    d = stored(d.join(sizes, F.col("scope").eqNullSafe(F.col("of"))).select("x", "lx", "v", "scope", "blocks", F.pmod(F.xxhash64("x"), "blocks").alias("block")), "blocks")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = d if asked is None else d.join(asked.select(F.col(key).alias("x")), "x", "left_semi")
    left = left.select("scope", F.col("block").alias("i"), every.alias("j"), "x", "lx", "v")
    right = d.select(F.col("scope").alias("scope2"), every.alias("i2"), F.col("block").alias("j2"), F.col("x").alias("y"), F.col("lx").alias("ly"), F.col("v").alias("w"))  # as one side of a cogroup must not have columns of the other
    kind, ids = df.schema[label].dataType.simpleString(), df.schema[key].dataType.simpleString()

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            y, codes, labels = np.array(b["w"].tolist(), float), *pd.factorize(b["ly"], use_na_sentinel=False)
            x = np.array(a["v"].tolist(), float)
            of, sizes = np.eye(len(labels))[codes], np.bincount(codes, minlength=len(labels))
            total, n = _sums(x, y, of), np.tile(sizes, (len(x), 1))
            same = pd.DataFrame({"x": a["x"].to_numpy(), "p": range(len(x))}).merge(pd.DataFrame({"x": b["y"].to_numpy(), "q": range(len(y))}), on="x")
            p, q = same["p"].to_numpy(), same["q"].to_numpy()  # a unit isn't one of the others
            np.subtract.at(total, (p, codes[q]), np.sqrt(((x[p] - y[q]) ** 2).sum(1)))
            np.subtract.at(n, (p, codes[q]), 1)
            out = [pd.DataFrame({"x": a["x"], "lx": a["lx"], "ly": name, "total": total[:, k], "n": n[:, k]}) for k, name in enumerate(labels)]
        return pd.concat(out) if out else pd.DataFrame({"x": [], "lx": [], "ly": [], "total": [], "n": []})

    met = left.groupBy("scope", "i", "j").cogroup(right.groupBy("scope2", "i2", "j2")).applyInPandas(pairs, f"x {ids}, lx {kind}, ly {kind}, total double, n long")
    sums = met.groupBy("x", "lx", "ly").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(F.col("x").alias(key), F.col("lx").alias(label), F.col("ly").alias("other"), "total", "n")


def silhouette_exact(df: DataFrame, label: str = "label", key: str = "unit") -> DataFrame:
    """The same by Euclidean distance, from the sums of distances over all pairs."""
    d = distance_sums(df, label, key).filter("n > 0").withColumn("d", F.col("total") / F.col("n"))
    own = F.col("other") == F.col(label)
    p = d.groupBy(key).agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("silhouette"))


def choose_k(vectors: DataFrame, ks: list[int], seed: int) -> DataFrame:
    """k, silhouette, best: a fit for each k."""
    out = None
    for k in ks:
        one = silhouette(cluster_regimes(vectors, k, seed), "cluster").select(F.lit(k).alias("k"), "silhouette")
        out = one if out is None else out.union(one)
    best = F.row_number().over(Window.orderBy(F.desc("silhouette"), "k")) == 1
    return out.withColumn("best", best)


def cluster_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: clusters, smallest over largest, entropy of shares over log(max(2, clusters))."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    d = c.withColumn("e", -p * F.log(p))
    return d.agg(F.count(F.lit(1)).alias("k"), F.round(F.min("n") / F.max("n"), 9).alias("balance"), F.round(F.sum("e") / F.log(F.greatest(F.lit(2), F.count(F.lit(1)))), 9).alias("entropy"))


def score_k(df: DataFrame, weights: dict[str, float], inverted: set[str], max_k: int) -> DataFrame:
    """df (k and criteria) with a weighted score of min-max scaled criteria (constant: 1, all null: 0; inverted ones from 1
    down), its rank, and the rank among k up to max_k (among all, if none is)."""
    all_ = Window.partitionBy()

    def part(c: str) -> Column:
        low, high = F.min(c).over(all_), F.max(c).over(all_)
        s = F.when(high == low, 1.0).otherwise((F.col(c) - low) / (high - low))
        s = F.when(high == low, s).otherwise(1 - s) if c in inverted else s
        return F.when(high.isNull(), 0.0).otherwise(F.coalesce(s, F.lit(0.0)))

    used = {c: w for c, w in weights.items() if w > 0}
    score = sum((w * part(c) for c, w in used.items()), F.lit(0.0)) / sum(used.values())
    d = df.withColumn("score", F.round(score, 9))
    order = [F.desc("score"), F.col("k")]
    d = d.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    fits = (F.col("k") <= max_k) | (F.min("k").over(all_) > max_k)
    return d.withColumn("rank_within", F.when(fits, F.row_number().over(Window.partitionBy(fits).orderBy(*order))))


def reps_centroid(df: DataFrame, n: int, label: str = "label", key: str = "unit") -> DataFrame:
    """The n units nearest to the mean vector of each cluster; ties by key."""
    long = df.select(key, label, F.posexplode("v").alias("i", "x"))
    m = long.groupBy(label, "i").agg(F.avg("x").alias("m"))
    d = long.join(m, [label, "i"]).groupBy(label, key).agg(F.round(F.sqrt(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m")))), 9).alias("d"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy("d", key))).filter(F.col("rank") <= n).select(label, key, "rank")


SHELLS, TRIED = 32, 8  # of each cluster: shells that bounds go by, and units summed for a first best


def reps_medoid(df: DataFrame, label: str = "label", key: str = "unit") -> DataFrame:
    """The unit of each cluster with the least sum of Euclidean distances to the others, ties by key; units without a label
    are left out.

    Not all pairs are measured: below what a unit's sum can't be follows from moments of its cluster. The units of least
    bound are summed, and then those whose bound isn't above the best sum.
    """
    d, low = medoid_bounds(df, label, key)
    first = Window.partitionBy(label).orderBy("low", key)
    tried = stored(low.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= TRIED).select(label, key), "tried")
    sums = stored(distance_sums(d, label, key, within=True, asked=tried), "sums")
    best = sums.groupBy(label).agg(F.min("total").alias("best"))
    rest = stored(low.join(best, label).filter(F.col("low") <= F.col("best") * (1 + 1e-9) + 1e-6).select(label, key).join(tried, key, "left_anti"), "rest")
    sums = sums.unionByName(distance_sums(d, label, key, within=True, asked=rest))
    return sums.groupBy(label).agg(F.min(F.struct(F.round("total", 6).alias("d"), F.col(key).alias("x"))).alias("s")).select(label, F.col("s.x").alias(key), F.col("s.d").alias("total"))


def medoid_bounds(df: DataFrame, label: str = "label", key: str = "unit") -> tuple[DataFrame, DataFrame]:
    """(the units, (label, key, low)): a lower bound of the sum of a unit's distances to its cluster.

    A cluster's units are taken in SHELLS shells by their distance to its mean. With h and z for x and y from the mean, and
    M^2 = h^2 + the mean of z^2 in a shell, |x - y| is M sqrt(1 + s) with s = (z^2 - 2 h z + h^2) / M^2 - 1, and sqrt(1 + s)
    is at least 1 + s / 2 - k s^2, k being 1/2 at most and less where s stays above -1. Summed over a shell this is a
    polynomial in h whose coefficients are moments of the shell, so all bounds take two readings of the units. Means and
    moments, a few for each cluster, are broadcast.
    """
    spark, kind, ids = df.sparkSession, df.schema[label].dataType.simpleString(), df.schema[key].dataType.simpleString()
    d = stored(df.select(key, label, "v").filter(F.col(label).isNotNull()), "units")
    mean = d.select(label, F.posexplode("v").alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    mean = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))  # as long as a vector
    far = d.join(mean, label).select(label, distance(F.col("v"), F.col("m")).alias("far"))
    cuts = far.groupBy(label).agg(F.percentile_approx("far", F.array(*[F.lit(i / SHELLS) for i in range(1, SHELLS)]), F.lit(1000)).alias("cuts"))
    known = {r[label]: (np.array(r["m"]), np.array(r["cuts"])) for r in mean.join(cuts, label).collect()}  # a row for each cluster
    known = spark.sparkContext.broadcast(known)

    def parts(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, labels = _rows(b.column("v")), np.array(b.column(label).to_pylist(), dtype=object)
            out = []
            for name, (m, cuts) in known.value.items():
                z = x[labels == name] - m
                r = np.sqrt((z**2).sum(1))
                shell = np.searchsorted(cuts, r)
                out += [(name, int(k), Shell.of(z[shell == k], r[shell == k]).packed()) for k in np.unique(shell)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], b.schema.field(label).type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], [label, "shell", "moments"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({label: rows[label][:1], "shell": rows["shell"][:1], "moments": [Shell.sum(rows["moments"]).packed()]})

    partial = d.select(label, "v").mapInArrow(parts, f"{label} {kind}, shell int, moments binary")
    whole = partial.groupBy(label, "shell").applyInPandas(added, f"{label} {kind}, shell int, moments binary").collect()  # SHELLS rows for each cluster
    shells = spark.sparkContext.broadcast([(r[label], Shell.sum([r["moments"]])) for r in whole])

    def bounds(batches):
        for b in batches:
            x, labels, low = _rows(b.column("v")), np.array(b.column(label).to_pylist(), dtype=object), np.zeros(b.num_rows)
            for name, shell in shells.value:
                some = labels == name
                if some.any():
                    low[some] += shell.least(x[some] - known.value[name][0])
            yield pa.RecordBatch.from_arrays([b.column(label), b.column(key), pa.array(low)], [label, key, "low"])

    return d, stored(d.select(label, key, "v").mapInArrow(bounds, f"{label} {kind}, {key} {ids}, low double"), "bounds")


def _rows(v: pa.ListArray) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


class Shell:
    """Moments of vectors z of lengths between `inner` and `outer`, which bound sums of distances to them."""

    def __init__(self, inner: float, outer: float, numbers: np.ndarray, vectors: np.ndarray, squares: np.ndarray):
        self.inner, self.outer, self.numbers, self.vectors, self.squares = inner, outer, numbers, vectors, squares

    @classmethod
    def of(cls, z: np.ndarray, r: np.ndarray) -> Shell:
        return cls(r.min(), r.max(), np.array([len(r), r.sum(), (r**2).sum(), (r**4).sum()]), np.stack([z.sum(0), (z * r[:, None] ** 2).sum(0)]), z.T @ z)

    def packed(self) -> bytes:
        return np.concatenate([[self.inner, self.outer, len(self.squares)], self.numbers, self.vectors.ravel(), self.squares.ravel()]).tobytes()

    @classmethod
    def sum(cls, packed) -> Shell:
        rows = np.array([np.frombuffer(p) for p in packed])
        n, total = int(rows[0, 2]), rows[:, 3:].sum(0)
        return cls(rows[:, 0].min(), rows[:, 1].max(), total[:4], total[4 : 4 + 2 * n].reshape(2, n), total[4 + 2 * n :].reshape(n, n))

    def least(self, h: np.ndarray) -> np.ndarray:
        """For each row of h, a lower bound of the sum of its distances to all z."""
        t = np.sqrt((h**2).sum(1))
        n, r, r2, r4 = self.numbers
        z, z2 = (h @ v for v in self.vectors)
        own = r2 / n
        m = np.maximum(own + t**2, 1e-300)
        s = -2 * z / m
        s2 = (r4 - 2 * own * r2 + n * own**2 - 4 * (z2 - own * z) + 4 * ((h @ self.squares) * h).sum(1)) / m**2
        nearest = np.where(t < self.inner, self.inner - t, np.where(t > self.outer, t - self.outer, 0))
        bound = np.sqrt(m) * (n + s / 2 - _bend(nearest**2 / m - 1) * np.maximum(0, s2))
        return np.maximum(np.abs(n * t - r), bound * (1 - 1e-9))


def _bend(s: np.ndarray) -> np.ndarray:
    """The least k with sqrt(1 + x) >= 1 + x / 2 - k x^2 for all x from s (-1 at least) on: that of s itself."""
    return 0.5 / (1 + np.sqrt(np.clip(1 + s, 0, 1))) ** 2


def rep_metric_summary(reps: DataFrame, scores: DataFrame, key: str = "unit") -> DataFrame:
    d = scores.join(reps.select(key).distinct(), key, "left_semi")
    return d.groupBy("method", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labelings; 1 where both are trivial."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    both = c.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    side = lambda x, name: c.groupBy(x).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    d = both.crossJoin(side(a, "i")).crossJoin(side(b, "j"))
    chance = F.col("i") * F.col("j") / pairs(F.col("n"))
    top, bottom = F.col("ij") - chance, (F.col("i") + F.col("j")) / 2 - chance
    return d.select(F.round(F.when(bottom == 0, 1.0).otherwise(top / bottom), 9).alias("ari"))


def project_2d(df: DataFrame, key: str = "unit") -> DataFrame:
    """key, px, py: the first two principal components of the centred vectors."""
    long = df.select(key, F.posexplode("v").alias("i", "x"))
    m = long.groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    d = df.crossJoin(F.broadcast(m)).select(key, array_to_vector(F.zip_with("v", "m", lambda x, y: x - y)).alias("f"))  # one row
    p = vector_to_array(F.col("p"))
    return PCA(k=2, inputCol="f", outputCol="p").fit(d).transform(d).select(key, p[0].alias("px"), p[1].alias("py"))


def radius_components(df: DataFrame, r: float, key: str = "unit") -> DataFrame:
    """key, root of points (key, x, y): components of the graph that links points within r, named by their smallest key;
    a point without coordinates is its own.

    Points of a grid cell whose diagonal is r are linked by construction, so components are those of cells, and all that
    has to be known of two cells is whether some pair of their points is within r. That follows from the bounds of their
    points, or else from those of ever smaller boxes, a quarter as wide each time, of the cells that are still in doubt.
    """
    width = r / 2**0.5 * (1 - 1e-9)
    d = df.filter("x is not null and y is not null").select(key, F.col("x").cast("double"), F.col("y").cast("double"))
    d = stored(d.withColumn("gx", F.floor(F.col("x") / width)).withColumn("gy", F.floor(F.col("y") / width)), "points")
    ends = [f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]
    cells = stored(d.groupBy("gx", "gy").agg(F.min(key).alias("cell"), *ends), "cells")
    bounds = [f"{c}_{n}" for c in "xy" for n in ("low", "high")]
    side = lambda rows, p, *cols: rows.select(*cols, *[F.col(c).alias(f"{p}{c}") for c in bounds])

    # each cell against half of the cells around it; those two away in both directions may still touch
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)])
    first = side(cells, "a_", "gx", "gy", F.col("cell").alias("a"), F.explode(around).alias("s"))
    first = first.withColumn("gx", F.col("gx") + F.col("s.i")).withColumn("gy", F.col("gy") + F.col("s.j")).drop("s")
    met = stored(_judged(first.join(side(cells, "b_", "gx", "gy", F.col("cell").alias("b")), ["gx", "gy"]), r).select("a", "b", "sure"), "met")
    links, doubt = [met.filter("sure").select("a", "b")], met.filter("not sure").select("a", "b", *[F.lit(0).cast("long").alias(c) for c in ("ax", "ay", "bx", "by")])
    doubt, level = stored(doubt, "doubt"), 0
    points = d.join(cells.select("gx", "gy", "cell"), ["gx", "gy"]).select("cell", "x", "y", *[(F.col(c) / width - F.col(f"g{c}")).alias(f"u{c}") for c in "xy"])
    while not doubt.isEmpty():
        level += 1
        at = lambda c, n: F.least(F.lit(4**n - 1), F.floor(F.col(f"u{c}") * 4**n)).cast("long")  # noqa: B023, E731
        open_ = doubt.select(F.col("a").alias("cell")).union(doubt.select("b")).distinct()
        boxes = points.join(open_, "cell", "left_semi").groupBy("cell", at("x", level).alias("kx"), at("y", level).alias("ky")).agg(*ends)
        boxes = stored(boxes.withColumn("px", F.shiftright("kx", 2)).withColumn("py", F.shiftright("ky", 2)), "boxes")  # the box that it is part of
        left = side(boxes, "a_", F.col("cell").alias("a"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("kx").alias("nax"), F.col("ky").alias("nay"))
        right = side(boxes, "b_", F.col("cell").alias("b"), F.col("px").alias("bx"), F.col("py").alias("by"), F.col("kx").alias("nbx"), F.col("ky").alias("nby"))
        met = _judged(doubt.join(left, ["a", "ax", "ay"]).join(right, ["b", "bx", "by"]), r)
        met = stored(met.select("a", "b", "sure", *[F.col(f"n{c}").alias(c) for c in ("ax", "ay", "bx", "by")]), "met")
        new = stored(met.filter("sure").select("a", "b").distinct(), "found")
        links.append(new)
        doubt = stored(met.filter("not sure").drop("sure").join(new, ["a", "b"], "left_anti"), "doubt")
    roots = components(reduce(DataFrame.union, links)).withColumnRenamed("node", "cell")
    of = cells.select("gx", "gy", "cell").join(roots, "cell", "left").select("gx", "gy", F.coalesce("root", "cell").alias("root"))
    return df.select(key).join(d.join(of, ["gx", "gy"]).select(key, "root"), key, "left").withColumn("root", F.coalesce("root", key))


def _judged(pairs: DataFrame, r: float) -> DataFrame:
    """Pairs of boxes by the bounds of their points (a_x_low and so on): sure, if all of one's points are within r of all of
    the other's, not sure, if some may be; others are left out. Boxes of one point each are never in doubt."""
    e = lambda n: F.col(n)
    least = lambda c: F.greatest(F.lit(0.0), e(f"b_{c}_low") - e(f"a_{c}_high"), e(f"a_{c}_low") - e(f"b_{c}_high"))
    most = lambda c: F.greatest(F.abs(e(f"b_{c}_high") - e(f"a_{c}_low")), F.abs(e(f"a_{c}_high") - e(f"b_{c}_low")))
    square = lambda f: f("x") * f("x") + f("y") * f("y")
    return pairs.filter(square(least) <= r * r).withColumn("sure", square(most) <= r * r)


def region_bounds(df: DataFrame, flag: str, pad: float = 0.2) -> DataFrame:
    """One row: bounds of the points (x, y) with the flag, padded by a share of their extent; of all, if none has it."""
    some = F.count_if(F.col(flag)) > 0

    def ends(c: str) -> list[Column]:
        low = F.when(some, F.min(F.when(F.col(flag), F.col(c)))).otherwise(F.min(c))
        high = F.when(some, F.max(F.when(F.col(flag), F.col(c)))).otherwise(F.max(c))
        return [(low - pad * (high - low)).alias(f"{c}_low"), (high + pad * (high - low)).alias(f"{c}_high")]

    return df.agg(*ends("x"), *ends("y"))


def hull(df: DataFrame, by: str, per_bucket: int = 100_000) -> DataFrame:
    """by, place, x, y: the corners of each group's convex hull, against the clock from the leftmost lowest.

    The hull of hulls of hash buckets is the hull; a group has a bucket for each `per_bucket` of its points, so no task
    gets a whole group.
    """

    def corners(points: pd.DataFrame) -> np.ndarray:
        p = np.unique(points[["x", "y"]].to_numpy(float), axis=0)

        def half(points):
            out = []
            for q in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out

        return np.array(half(p)[:-1] + half(p[::-1])[:-1]) if len(p) > 2 else p

    def part(points: pd.DataFrame) -> pd.DataFrame:
        c = corners(points)
        return pd.DataFrame({by: points[by].iat[0], "x": c[:, 0], "y": c[:, 1]})

    def whole(points: pd.DataFrame) -> pd.DataFrame:
        return part(points).reset_index(names="place")[[by, "place", "x", "y"]]

    kind = df.schema[by].dataType.simpleString()
    d = df.filter("x is not null and y is not null").select(by, "x", "y")
    sizes = d.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / per_bucket).alias("_buckets"))
    d = d.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).select(by, "x", "y", F.pmod(F.xxhash64("x", "y"), F.col("_buckets")).alias("bucket"))
    d = d.groupBy(by, "bucket").applyInPandas(part, f"{by} {kind}, x double, y double")
    return d.groupBy(by).applyInPandas(whole, f"{by} {kind}, place long, x double, y double")
