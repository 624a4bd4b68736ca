"""Do subsets keep the ranking of methods (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import running_counts, running_sums
from ..sources.tables import stored

LOWER_IS_BETTER = {"lpips", "disc"}


def method_means(long: DataFrame, subset: DataFrame) -> DataFrame:
    """metric, method, n_full, n_subset and the means of both."""
    d = long.join(subset.select("unit", F.lit(True).alias("s")).distinct(), "unit", "left")
    inside = F.when(F.col("s"), F.col("value"))
    return d.groupBy("metric", "method").agg(F.count("value").alias("n_full"), F.count(inside).alias("n_subset"), F.avg("value").alias("full_mean"), F.avg(inside).alias("subset_mean"))


def rank_methods(means: DataFrame, value: str, by: list[str] = ("metric",)) -> DataFrame:
    """Dense, average and ordinal (ties by name) ranks; 1 is best, by the metric's direction."""
    better = F.when(F.col("metric").isin(sorted(LOWER_IS_BETTER)), F.col(value)).otherwise(-F.col(value))
    w = Window.partitionBy(*by).orderBy("_v")
    d = means.withColumn("_v", F.round(better, 9))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, "_v"))
    return d.select("*", F.dense_rank().over(w).alias("dense"), (F.rank().over(w) + (ties - 1) / 2).alias("average"), F.row_number().over(w.orderBy("_v", "method")).alias("ordinal")).drop("_v")


def correlation_of_ranks(ranks: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Spearman's rho from average ranks a and b."""
    return ranks.groupBy(*by).agg(F.round(F.corr(a, b), 9).alias("rho"))


def kendall(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau-b of two columns over the rows of each group; rows that lack one don't take part, constants: null.

    No pairs are made. Rows are ranked by a (ties share a rank); two ranks first differ in one binary digit, and rows that
    agree in the digits before it form a group in which those with 0 there come before those with 1. Running sums over
    the ranks by b inside such groups count how many pairs b orders alike and how many the other way. A row comes once
    for each digit, so the work grows with n log n, and no group is gathered in one task.
    """
    d = stored(df.select(*by, F.round(a, 9).alias("_x"), F.round(b, 9).alias("_y")).na.drop(subset=["_x", "_y"]), "pairs")
    ca, cb = (stored(running_counts(d, by, c).select(*by, c, F.col("lt").alias(f"{c}_rank"), "c", "n"), "ranks") for c in ("_x", "_y"))
    ties = lambda c: c.groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("ties"))
    ranks = d.join(ca.select(*by, "_x", "_x_rank", "n"), [*by, "_x"]).join(cb.select(*by, "_y", "_y_rank"), [*by, "_y"])
    digit = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2("n"))).cast("int")))
    ranks = ranks.select(*by, "_x_rank", "_y_rank", digit.alias("_digit"))
    one = F.expr("shiftright(_x_rank, _digit) & 1")
    c = ranks.select(*by, "_digit", F.expr("shiftright(_x_rank, _digit + 1)").alias("_above"), "_y_rank", (1 - one).alias("_0"), one.alias("_1"))
    group = [*by, "_digit", "_above"]
    c = stored(c.groupBy(*group, "_y_rank").agg(F.sum("_0").alias("_0"), F.sum("_1").alias("_1")), "digits")
    total = c.groupBy(*group).agg(F.sum("_0").alias("_total"), F.sum("_1").alias("_ones")).filter("_total > 0 and _ones > 0").drop("_ones")
    c = running_sums(c.join(total, group), group, "_y_rank", ["_0"])
    s = c.groupBy(*by).agg(F.sum(F.col("_1") * ((F.col("upto__0") - F.col("_0")) - (F.col("_total") - F.col("upto__0")))).alias("s"))
    t = ties(ca).join(ties(cb).select(*by, F.col("ties").alias("ties_b")), by) if by else ties(ca).crossJoin(ties(cb).select(F.col("ties").alias("ties_b")))
    t = t.join(s, by, "left") if by else t.crossJoin(s)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    under = F.sqrt((pairs - F.col("ties")) * (pairs - F.col("ties_b")))
    return t.select(*by, F.round(F.when(under > 0, F.coalesce("s", F.lit(0)) / under), 9).alias("tau"))


def pairwise_agreement(ranks: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Share of method pairs that both columns order alike."""
    x, y = ranks.alias("x"), ranks.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in by] + [F.col("x.method") < F.col("y.method")]
    same = F.signum(F.round(F.col(f"x.{a}") - F.col(f"y.{a}"), 9)) == F.signum(F.round(F.col(f"x.{b}") - F.col(f"y.{b}"), 9))
    return x.join(y, on).groupBy(*[F.col(f"x.{k}").alias(k) for k in by]).agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(same.cast("int")), 9).alias("agreement"))


def top_agreement(means: DataFrame, tolerance: float) -> DataFrame:
    """Per metric: do the best methods (within the tolerance of the best) of the population and the subset meet."""
    w = Window.partitionBy("metric")
    sign = F.when(F.col("metric").isin(sorted(LOWER_IS_BETTER)), -1.0).otherwise(1.0)
    near = lambda c: sign * F.col(c) >= F.max(sign * F.col(c)).over(w) - tolerance
    d = means.withColumn("f", near("full_mean")).withColumn("s", near("subset_mean"))
    tops = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("method"))))
    d = d.groupBy("metric").agg(tops("f").alias("f"), tops("s").alias("s"))
    return d.select("metric", F.array_join("f", ",").alias("full_top"), F.array_join("s", ",").alias("subset_top"), F.arrays_overlap("f", "s").alias("agree"))


def method_table(long: DataFrame) -> DataFrame:
    """metric, method, n, mean, sample deviation, and all methods of the metric from best to worst."""
    d = long.groupBy("metric", "method").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    r = rank_methods(d, "m")
    order = r.groupBy("metric").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "method"))), lambda x: x["method"]), ">").alias("ordering"))
    return r.join(order, "metric").select("metric", "method", "n", F.round("m", 6).alias("mean"), F.round("sd", 6).alias("sd"), "ordering")


def rank_match(means: DataFrame) -> DataFrame:
    """Per metric: exact match of the rank lists, and whether the subset keeps the population's order of the shared units."""
    full = rank_methods(means, "full_mean").select("metric", "method", F.col("ordinal").alias("f"), F.col("dense").alias("fd"))
    sub = rank_methods(means, "subset_mean").select("metric", "method", F.col("ordinal").alias("s"), F.col("dense").alias("sd"))
    d = full.join(sub, ["metric", "method"])
    return d.groupBy("metric").agg(F.every(F.col("f") == F.col("s")).alias("order_kept"), F.every(F.col("fd") == F.col("sd")).alias("exact_match"))
