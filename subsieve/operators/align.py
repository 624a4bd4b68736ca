"""Populations and coverage of several methods put side by side (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import drop_incomplete
from .fidelity import ks_distance


def population(mapping: DataFrame, metrics: DataFrame, required: list[str]) -> DataFrame:
    return drop_incomplete(mapping.join(metrics, "unit"), ["unit"], required)


def combined(mapping: DataFrame, first: DataFrame, second: DataFrame, runtime: DataFrame, split: DataFrame | None = None) -> DataFrame:
    d = mapping.join(first, "unit").join(second, "unit").join(runtime, "unit", "left")
    return d if split is None else d.join(split.select("unit"), "unit", "left_semi")


def common_ids(long: DataFrame, n: int) -> DataFrame:
    """Units that all n methods have."""
    return long.select("unit", "method").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == n).select("unit")


def restrict(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("unit"), "unit", "left_semi")


def missing_per_method(long: DataFrame, shared: DataFrame) -> DataFrame:
    """Units that a method has outside the shared ones."""
    return long.select("method", "unit").distinct().join(shared.select("unit"), "unit", "left_anti").select("method", "unit")


def coverage(long: DataFrame, subset: DataFrame, shared: DataFrame) -> DataFrame:
    """Per metric and method: units, those in the subset, in the shared ones, and in both."""
    d = long.select("metric", "method", "unit").distinct().join(subset.select("unit", F.lit(1).alias("s")).distinct(), "unit", "left").join(shared.select("unit", F.lit(1).alias("c")).distinct(), "unit", "left")
    count = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return d.groupBy("metric", "method").agg(F.count(F.lit(1)).alias("n_full"), count("s", "n_subset"), count("c", "n_shared"), count(F.col("s") * F.col("c"), "n_shared_subset"))


def coverage_range(cover: DataFrame) -> DataFrame:
    return cover.groupBy("method").agg(F.min("n_full").alias("least_full"), F.max("n_full").alias("most_full"), F.min("n_subset").alias("least_subset"), F.max("n_subset").alias("most_subset"))


def coverage_bias(pop: DataFrame, covered: DataFrame, tau_gap: float, tau_ks: float) -> DataFrame:
    """One row for pop (unit, regime, value): covered and missing units, their mean gap and KS distance, whether these are
    over tolerance, and the largest shift of a regime's share."""
    d = pop.join(covered.select("unit", F.lit(True).alias("has")).distinct(), "unit", "left").withColumn("side", F.coalesce("has", F.lit(False)))
    side, other = F.when(F.col("side"), F.col("value")), F.when(~F.col("side"), F.col("value"))
    total = d.agg(F.count_if("side").alias("n_covered"), F.count_if(~F.col("side")).alias("n_missing"), (F.avg(side) - F.avg(other)).alias("gap"))
    ks = ks_distance(d, []).select("ks")
    share = d.groupBy("regime").agg(F.count_if("side").alias("a"), F.count_if(~F.col("side")).alias("b")).crossJoin(total)
    shift = share.agg(F.round(F.max(F.abs(F.col("a") / F.col("n_covered") - F.col("b") / F.col("n_missing"))), 9).alias("max_share_shift"))
    out = total.crossJoin(ks).crossJoin(shift)
    return out.select("n_covered", "n_missing", F.round("gap", 6).alias("gap"), "ks", (F.abs("gap") > tau_gap).alias("gap_over"), (F.col("ks") > tau_ks).alias("ks_over"), "max_share_shift")


def split_filter(df: DataFrame, split: DataFrame, part: str) -> DataFrame:
    return df if part == "all" else df.join(split.filter(F.col("split") == part).select("unit"), "unit", "left_semi")


def regime_support(pop: DataFrame, largest: int) -> DataFrame:
    d = pop.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    return d.select("regime", "n", (F.col("n") >= largest).alias("supported"))


def align_methods(long: DataFrame, methods: list[str]) -> DataFrame:
    """unit, then a column for each method, of units that all of them have."""
    return long.groupBy("unit").pivot("method", methods).agg(F.first("value")).na.drop()
