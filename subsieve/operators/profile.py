"""Profiles of wide tables, worked out in long form (feature, value), and transforms that follow from them (C, D)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjusted_skewness, quantiles, rounded_ratio, running_counts, running_sums, to_double, unpivot
from ..sources.tables import stored

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def long_form(df: DataFrame, cols: list[str], ids: list[str] = ()) -> DataFrame:
    return unpivot(df, list(ids), cols)


def feature_summary(long: DataFrame) -> DataFrame:
    """feature, n, mean, std (ddof 0), quartiles, iqr, min, max, missing_pct, outliers (beyond 1.5 IQR) and their percent of all rows."""
    base = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    d = base.join(quantiles(long, ["feature"], QUARTILES), "feature", "left").withColumn("iqr", F.col("q3") - F.col("q1"))
    out = outlier_stats(long, d)
    d = d.join(out, "feature").withColumn("missing_pct", 100 * (F.col("rows") - F.col("n")) / F.col("rows"))
    return d.select("feature", "n", "mean", "std", "median", "q1", "q3", "iqr", "min", "max", "missing_pct", "outliers", "outlier_pct")


def outlier_stats(long: DataFrame, quarts: DataFrame) -> DataFrame:
    """feature, outliers, outlier_pct: values strictly outside q1 - 1.5 IQR and q3 + 1.5 IQR, in percent of all rows."""
    q = quarts.select("feature", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    far = (F.round("value", 9) < F.round("low", 9)) | (F.round("value", 9) > F.round("high", 9))
    d = long.join(F.broadcast(q), "feature")  # a row for each feature
    return d.groupBy("feature").agg(F.count_if(far).alias("outliers"), F.round(100 * F.count_if(far) / F.count(F.lit(1)), 6).alias("outlier_pct"))


def inspect_features(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), adjusted_skewness("value").alias("skew"))


def missingness(long: DataFrame) -> DataFrame:
    """Per feature: percent missing and complete, partial or absent; the worst first."""
    pct = F.round(100 * (F.count(F.lit(1)) - F.count("value")) / F.count(F.lit(1)), 6)
    d = long.groupBy("feature").agg(pct.alias("missing_pct"))
    return d.withColumn("status", F.when(F.col("missing_pct") == 0, "complete").when(F.col("missing_pct") == 100, "absent").otherwise("partial")).orderBy(F.desc("missing_pct"), "feature")


def correlation_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, corr for each two columns, over the rows that have both (NaN counts as missing); null where either is constant
    there.

    Each task turns its rows into partial Gram matrices: for every two columns the number of rows that have both, and the
    sums of either, of their squares and of their products over these, less the columns' means, so that nothing cancels.
    A row of the matrices is added up over tasks at a time; the plan is as small for 500 columns as for two.
    """
    cols = sorted(cols)
    d = df.select(*[to_double(F.col(c)).alias(f"x{i}") for i, c in enumerate(cols)])
    mean = np.array([x or 0.0 for x in d.agg(*[F.avg(c) for c in d.columns]).first()])  # a number for each column
    d = d.unionByName(df.sparkSession.createDataFrame([(None,) * len(cols)], d.schema))  # adds nothing, and makes an empty table one with rows

    def grams(batches):
        sums = np.zeros((4, len(cols), len(cols)))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - mean
            has = ~np.isnan(x)
            x, has = np.where(has, x, 0.0), has.astype(float)
            sums += [has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x]
        n, s, q, p = sums
        rows = np.concatenate([n, s, s.T, q, q.T, p], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cols)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["i", "sums"])

    def correlated(rows: pa.Table) -> pa.Table:
        i = rows["i"][0].as_py()
        n, sa, sb, qa, qb, p = np.sum([np.frombuffer(r) for r in rows["sums"].to_pylist()], axis=0).reshape(6, len(cols))[:, i + 1 :]
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = qa - sa * sa / n, qb - sb * sb / n
            r = np.where((n > 1) & (va > 1e-13 * qa) & (vb > 1e-13 * qb), (p - sa * sb / n) / np.sqrt(va * vb), np.nan)
        return pa.table([pa.array([cols[i]] * len(r), pa.string()), pa.array(cols[i + 1 :], pa.string()), pa.array(r, mask=np.isnan(r))], names=["a", "b", "corr"])

    return d.mapInArrow(grams, "i int, sums binary").groupBy("i").applyInArrow(correlated, "a string, b string, corr double")


def top_correlated(corr: DataFrame, k: int) -> DataFrame:
    return corr.filter("corr is not null").orderBy(F.desc(F.round(F.abs("corr"), 9)), "a", "b").limit(k)


def failure_summary(df: DataFrame, code: str = "error_code") -> DataFrame:
    return df.filter(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), code)


def drift(cur: DataFrame, base: DataFrame, t_mean: float, t_missing: float) -> DataFrame:
    """Per common feature of two long tables: change of the mean and of the percent missing, and whether either is at least its threshold."""
    s = lambda d, p: d.groupBy("feature").agg(F.avg("value").alias(f"{p}_mean"), (100 * (F.count(F.lit(1)) - F.count("value")) / F.count(F.lit(1))).alias(f"{p}_missing"))
    d = s(cur, "c").join(s(base, "b"), "feature")
    dm, dx = F.col("c_mean") - F.col("b_mean"), F.col("c_missing") - F.col("b_missing")
    return d.select("feature", F.round(dm, 6).alias("mean_delta"), F.round(dx, 6).alias("missing_delta"), ((F.abs(dm) >= t_mean) | (F.abs(dx) >= t_missing)).alias("changed"))


def correlation_drift(cur: DataFrame, base: DataFrame) -> DataFrame:
    """One row: mean and largest absolute change of correlations that both have; nulls where there are none."""
    d = cur.join(base.withColumnRenamed("corr", "was"), ["a", "b"]).withColumn("d", F.abs(F.col("corr") - F.col("was")))
    return d.agg(F.count("d").alias("n_pairs"), F.round(F.avg("d"), 6).alias("mean_change"), F.round(F.max("d"), 6).alias("max_change"))


def quality_gate(failures: DataFrame, n_units: Column, missing: DataFrame, max_failed: float, max_missing: float) -> DataFrame:
    """One row: share of failed units and the worst percent missing, each against its limit."""
    f = failures.agg((F.sum("failed") / n_units).alias("failed_share"))
    return f.crossJoin(missing.agg(F.max("missing_pct").alias("worst_missing"))).select(F.round("failed_share", 9).alias("failed_share"), "worst_missing", (F.col("failed_share") <= max_failed).alias("failed_ok"), (F.col("worst_missing") <= max_missing).alias("missing_ok"))


def winsor_bounds(long: DataFrame, low: float, high: float) -> DataFrame:
    """Percentile bounds for each feature, widened by 0.5 to both sides where they are equal."""
    q = quantiles(long, ["feature"], {"low": low, "high": high})
    same = F.col("low") == F.col("high")
    return q.select("feature", F.when(same, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(same, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))


def group_profile(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in cols])


def regime_histogram(df: DataFrame, by: str) -> DataFrame:
    d = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # few groups


def histogram(long: DataFrame, bins: int) -> DataFrame:
    """feature, bin (0 to bins - 1), n: equal widths from the lowest to the highest value, which is in the last bin."""
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = long.filter("value is not null").join(F.broadcast(ends), "feature")
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor(F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins, 9)))).otherwise(0).cast("int")
    return d.groupBy("feature", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def inventory(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """source, rows, columns, distinct_ids of each source, and a row 'all' with the ids that all of them have."""
    out = None
    for name, df in sources.items():
        one = df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.count_distinct(key).alias("distinct_ids"))
        out = one if out is None else out.union(one)
    shared = None
    for df in sources.values():
        ids = df.select(key)
        shared = ids if shared is None else shared.intersect(ids)
    both = shared.agg(F.lit("all").alias("source"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("int").alias("columns"), F.count(F.lit(1)).alias("distinct_ids"))
    return out.union(both)


def varying_features(profile: DataFrame, cols: list[str], n: int) -> DataFrame:
    d = long_form(profile, cols).groupBy("feature").agg(F.round(F.stddev_pop("value"), 6).alias("std"))
    return d.orderBy(F.desc("std"), "feature").limit(n)


def ecdf_table(pop: DataFrame, subset: DataFrame) -> DataFrame:
    """value, pop_share, subset_share at each value of the population (a subset of it is the other)."""
    p = running_counts(pop, []).select("value", rounded_ratio(F.col("le"), F.col("n")).alias("pop_share"))
    marked = pop.join(subset.select("unit", F.lit(1).alias("s")).distinct(), "unit", "left")
    c = marked.groupBy("value").agg(F.sum(F.coalesce("s", F.lit(0))).alias("s"))
    c = running_sums(c, [], "value", ["s"]).crossJoin(c.agg(F.sum("s").alias("n")))
    return p.join(c.select("value", rounded_ratio(F.col("upto_s"), F.col("n")).alias("subset_share")), "value").select("value", "pop_share", "subset_share")


# ---- transforms


def select_log(stats: DataFrame) -> DataFrame:
    """feature, log: no where the least value is below 0, yes where |skew| > 1 or max/min > 100; min 0 is an infinite ratio."""
    ratio = (F.col("min") == 0) | (F.col("max") / F.when(F.col("min") != 0, F.col("min")) > 100)
    return stats.select("feature", F.coalesce((F.col("min") >= 0) & ((F.abs("skew") > 1) | ratio), F.lit(False)).alias("log"))


def select_scaler(stats: DataFrame) -> DataFrame:
    return stats.select("feature", F.coalesce(F.abs("skew") > 1, F.lit(False)).alias("robust"))


def _robust() -> Column:
    iqr = F.col("q3") - F.col("q1")
    return (F.col("value") - F.col("median")) / F.when(iqr == 0, 1.0).otherwise(iqr)


def _standard(mean: str, deviation: str) -> Column:
    return (F.col("value") - F.col(mean)) / F.when(F.col(deviation) == 0, 1.0).otherwise(F.col(deviation))


def robust_scale(long: DataFrame) -> DataFrame:
    q = quantiles(long, ["feature"], QUARTILES)
    return long.join(F.broadcast(q), "feature").select(*[c for c in long.columns if c != "value"], _robust().alias("value"))


def standard_scale(long: DataFrame) -> DataFrame:
    s = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return long.join(F.broadcast(s), "feature").select(*[c for c in long.columns if c != "value"], _standard("m", "s").alias("value"))


def clip(c: Column, limit: float = 3.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), c))


def normalize(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normalised long table, info): means for what is missing, log1p where select_log says so, then robust or standard
    scaling by the skew that is left, then clipping. info: feature, log, robust."""
    means = long.groupBy("feature").agg(F.avg("value").alias("_m"))
    d = long.join(F.broadcast(means), "feature").withColumn("value", F.coalesce("value", "_m")).drop("_m")
    log = select_log(inspect_features(d))
    d = d.join(F.broadcast(log), "feature").withColumn("value", F.when(F.col("log"), F.log1p("value")).otherwise(F.col("value"))).drop("log")
    d = stored(d, "logged")  # read for the skew, the quartiles and the scaling
    robust = select_scaler(inspect_features(d))
    scales = d.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")).join(quantiles(d, ["feature"], QUARTILES), "feature").join(robust, "feature")
    scaled = F.when(F.col("robust"), _robust()).otherwise(_standard("_m", "_s"))
    out = d.join(F.broadcast(scales), "feature").select(*[c for c in d.columns if c != "value"], clip(scaled).alias("value"))  # a row for each feature
    return out, log.join(robust, "feature")


def pool_embeddings(df: DataFrame, by: str, vec: str) -> DataFrame:
    """by, place, value: the mean vector of each group, scaled to length 1."""
    d = df.select(by, F.posexplode(vec).alias("place", "x")).groupBy(by, "place").agg(F.avg("x").alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(by)))
    return d.select(by, "place", (F.col("m") / norm).alias("value"))


def select_log_median(long: DataFrame) -> DataFrame:
    """feature, log: max / (median + 1e-6) above 100."""
    m = quantiles(long, ["feature"], {"median": 0.5}).join(long.groupBy("feature").agg(F.max("value").alias("max")), "feature")
    return m.select("feature", (F.col("max") / (F.col("median") + 1e-6) > 100).alias("log"))
