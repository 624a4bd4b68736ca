"""Frontiers, recommendations, selectors and sensitivity over the trial table (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson_lcb
from . import fidelity as fi


def frontier(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per budget: trials, passes, rate, lower bound, and the objectives and largest KS distance of the best draw (joint,
    mean, trial)."""
    by = by or []
    best = F.min(F.struct("joint_objective", "mean_objective", "trial", "max_ks"))
    d = events.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("ok").alias("n_pass"), best.alias("x"))
    return d.select(*by, "b", "n_trials", "n_pass", F.round(F.col("n_pass") / F.col("n_trials"), 9).alias("rate"), F.round(wilson_lcb(F.col("n_pass"), F.col("n_trials")), 9).alias("lcb"), F.col("x.trial").alias("best_trial"), F.col("x.joint_objective").alias("best_joint"), F.col("x.mean_objective").alias("best_mean"), F.col("x.max_ks").alias("best_max_ks"))


def best_draw_stats(front: DataFrame, trials: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, b, best_trial, method, metric, gap, ks: the distances of each budget's best draw."""
    by = by or []
    best = front.select(*by, "b", "best_trial", F.col("best_trial").alias("trial"))
    return trials.join(best, [*by, "b", "trial"]).select(*by, "b", "best_trial", "method", "metric", "gap", "ks")


def recommend(front: DataFrame, targets: list[float], by: list[str] | None = None) -> DataFrame:
    """First budget whose bound meets each target; null and a label where none does."""
    by = by or []
    d = front.select(*by, "b", "lcb", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    d = d.groupBy(*by, "target").agg(F.min(F.when(F.col("lcb") >= F.col("target"), F.col("b"))).alias("b"))
    return d.select(*by, "target", "b", F.when(F.col("b").isNull(), "not reached").otherwise("reached").alias("status"))


def recommendations(grid: DataFrame) -> DataFrame:
    """recommended, n, share: how often each size comes in a grid (size, null where none meets the target)."""
    d = grid.groupBy(F.coalesce(F.col("size").cast("string"), F.lit("not reached")).alias("recommended")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


def best_subset(events: DataFrame, draws: DataFrame, order: tuple[str, str] = ("joint_objective", "mean_objective")) -> DataFrame:
    """The units of the best draw for each budget."""
    best = events.groupBy("b").agg(F.min(F.struct(*order, "trial")).alias("x")).select("b", "x.trial")
    return draws.join(best, ["b", "trial"], "left_semi").select("b", "trial", "unit", "regime")


def select_budget(summary: DataFrame, target: float, max_size: int, need_manifest: bool = True) -> DataFrame:
    """One row: among feasible budgets, those with a manifest (all, if none has), up to max_size (all, if none is), the
    smallest that meets the target, else the one with the best bound; notes which rules were relaxed.

    `summary` has b, size, lcb, feasible, has_manifest; a row for each budget, so windows over all rows are small.
    """
    all_ = Window.partitionBy()
    d = summary.filter("feasible")
    some = F.max(F.col("has_manifest").cast("int")).over(all_) == 1
    d = d.withColumn("no_manifest", ~some if need_manifest else F.lit(False)).filter(F.col("has_manifest") | F.col("no_manifest") | F.lit(not need_manifest))
    d = d.withColumn("no_size", F.min("size").over(all_) > max_size).filter((F.col("size") <= max_size) | F.col("no_size"))
    meets = F.col("lcb") >= target
    d = d.withColumn("meets", meets).orderBy(F.desc("meets"), F.when(meets, F.col("size")), F.desc("lcb"), "size", "b").limit(1)
    return d.select("b", "size", "lcb", "meets", "no_manifest", "no_size")


def pareto(df: DataFrame, high: str, low: str) -> DataFrame:
    """Rows that no other row beats: a running maximum of `high` over growing `low`; equal rows stay together."""
    g = df.groupBy(low).agg(F.max(high).alias("_top"))
    before = Window.orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_before", F.max("_top").over(before)).filter(F.col("_before").isNull() | (F.col("_top") > F.col("_before")))
    return df.join(g.select(low, F.col("_top").alias(high)), [low, high], "left_semi")


def sweep_targets(summary: DataFrame, targets: list[float]) -> DataFrame:
    """Per target: the smallest size whose bound meets it, else the best bound."""
    d = summary.select("*", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")).withColumn("meets", F.col("lcb") >= F.col("target"))
    w = Window.partitionBy("target").orderBy(F.desc("meets"), F.when(F.col("meets"), F.col("size")), F.desc("lcb"), "size")
    return d.withColumn("at", F.row_number().over(w)).filter("at = 1").select("target", "b", "size", "lcb", "meets")


def threshold_sets(constraints: DataFrame, sets: dict[str, tuple[float, float]]) -> DataFrame:
    """Passes of the same trials when mean and KS tolerances are scaled by each set's factors."""
    largest = lambda kind: F.max(F.when(F.col("kind") == kind, F.round("ratio", 9)))
    d = constraints.groupBy("b", "trial").agg(largest("mean").alias("m"), largest("ks").alias("s"))  # all that a set asks of a trial
    names = F.array(*[F.struct(F.lit(k).alias("set"), F.lit(m).alias("fm"), F.lit(s).alias("fs")) for k, (m, s) in sets.items()])
    d = d.select("b", "m", "s", F.explode(names).alias("x"))
    ok = (F.col("m") <= F.col("x.fm")) & (F.col("s") <= F.col("x.fs"))
    d = d.groupBy("x.set", "b").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if(ok).alias("n_pass"))
    return d.withColumn("lcb", F.round(wilson_lcb(F.col("n_pass"), F.col("n_trials")), 9))


def tolerance_grid(constraints: DataFrame, means: list[float], kss: list[float], target: float) -> DataFrame:
    """Smallest recommended budget in each cell of a grid of tolerance factors."""
    grid = {f"{m}|{s}": (m, s) for m in means for s in kss}
    d = threshold_sets(constraints, grid).groupBy("set").agg(F.min(F.when(F.col("lcb") >= target, F.col("b"))).alias("b"))
    part = F.split("set", r"\|")
    return d.select(part[0].cast("double").alias("mean_factor"), part[1].cast("double").alias("ks_factor"), "b")


def knee(grid: DataFrame) -> DataFrame:
    """Along one axis: smallest feasible budget, and whether there is one."""
    return grid.groupBy("ks_factor").agg(F.min("b").alias("b")).withColumn("feasible", F.col("b").isNotNull())


def subset_overlap(subsets: DataFrame, name: str = "subset") -> DataFrame:
    """One row: over all pairs of subsets (name, unit), mean Jaccard index and mean overlap share of the smaller."""
    sizes = subsets.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    a, b = sizes.alias("a"), sizes.alias("b")
    pairs = a.join(b, F.col(f"a.{name}") < F.col(f"b.{name}")).select(F.col(f"a.{name}").alias("x"), F.col(f"b.{name}").alias("y"), F.col("a.n").alias("nx"), F.col("b.n").alias("ny"))
    s, t = subsets.select(F.col(name).alias("x"), "unit"), subsets.select(F.col(name).alias("y"), "unit")
    both = s.join(t, "unit").filter("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("both"))
    d = pairs.join(both, ["x", "y"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return d.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))), 9).alias("mean_jaccard"), F.round(F.avg(F.col("both") / F.least("nx", "ny")), 9).alias("mean_overlap"))


def failure_modes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per generator and budget: trials, those whose means hold, whose KS distances hold, that hold jointly with their
    bound, and whose means hold but a KS distance doesn't, with the first such trial of the lowest mean objective."""
    every = lambda kind: F.every(F.when(F.col("kind") == kind, F.col("ok")))
    t = rows.groupBy(*by, "b", "trial").agg(every("mean").alias("means"), every("ks").alias("kss"), F.every("ok").alias("ok"), F.round(F.max(F.when(F.col("kind") == "mean", F.col("ratio"))), 9).alias("objective"))
    bad = F.col("means") & ~F.col("ok")
    d = t.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("means").alias("n_means"), F.count_if("kss").alias("n_ks"), F.count_if("ok").alias("n_joint"), F.count_if(bad).alias("n_means_only"), F.min(F.when(bad, F.struct("objective", "trial")))["trial"].alias("example"))
    return d.withColumn("lcb", F.round(wilson_lcb(F.col("n_joint"), F.col("n_trials")), 9))


def exported_draws(events: DataFrame, by: list[str], orders: dict[str, tuple[str, str]]) -> DataFrame:
    """by, b, criterion, trial, mean_objective, joint_objective, max_ks, keeps_order: of each generator and budget the draw
    that each criterion exports. events: as joint_event returns it, with keeps_order; orders: columns, by criterion."""
    out = None
    for name, (first, second) in orders.items():
        best = F.min(F.struct(first, second, "trial", "max_ks", "keeps_order"))
        one = events.groupBy(*by, "b").agg(best.alias("x")).select(*by, "b", F.lit(name).alias("criterion"), "x.trial", "x.mean_objective", "x.joint_objective", "x.max_ks", "x.keeps_order")
        out = one if out is None else out.union(one)
    return out


def with_summaries(modes: DataFrame, summaries: DataFrame, by: str = "generator") -> DataFrame:
    """modes, and rows of baselines of which only (by, b, rate, lcb) is known: a note says so, what isn't known is null."""
    known = modes.withColumn("rate", F.round(F.col("n_joint") / F.col("n_trials"), 9)).withColumn("note", F.lit(""))
    return known.unionByName(summaries.select(by, "b", "rate", "lcb", F.lit("summary only").alias("note")), allowMissingColumns=True)


def selector_stability(picks: DataFrame, scores: DataFrame, tol: DataFrame) -> DataFrame:
    """One row: runs of a stochastic selector, how many pass the joint event, and how much their subsets overlap.

    picks: run, unit; every run picks a subset of the population that scores describes.
    """
    draws = picks.select(F.lit(0).alias("b"), F.col("run").alias("trial"), "unit").distinct()
    events = fi.joint_event(fi.constraints(fi.trial_stats(draws, scores), tol))
    passed = events.agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("ok").alias("n_pass"))
    return passed.crossJoin(subset_overlap(picks.select("run", "unit").distinct(), "run"))


def select_joint(summary: DataFrame, target: float, max_size: int | None = None, metric: str = "lcb") -> DataFrame:
    """One row of a joint sweep: among feasible rows whose best draw passes globally and in every regime, up to max_size
    (all of these, if none is; all feasible rows, if none passes), the smallest that meets the target, else the one with
    the best metric; ties by the metric, size, silhouette, balance, k and b.

    summary: k, b, size, rate, lcb, feasible, best_pass, best_regime_pass, silhouette, balance; few rows.
    """
    all_, strict = Window.partitionBy(), F.col("best_pass") & F.col("best_regime_pass")
    small = F.lit(True) if max_size is None else F.col("size") <= max_size
    some = lambda c: F.max(F.coalesce(c, F.lit(False))).over(all_)
    d = summary.filter("feasible").withColumn("_some", some(strict)).withColumn("_small", some(strict & small))
    d = d.filter(F.when(~F.col("_some"), True).when(F.col("_small"), strict & small).otherwise(strict)).withColumn("meets", F.col(metric) >= target)
    order = [F.desc("meets"), F.when(F.col("meets"), F.col("size")), F.desc(metric), "size", F.desc_nulls_last("silhouette"), F.desc_nulls_last("balance"), "k", "b"]
    return d.orderBy(*order).limit(1).select("k", "b", "size", "rate", "lcb", "silhouette", "balance", "meets")


def joint_sweep(summary: DataFrame, target: float, max_size: int | None = None) -> DataFrame:
    """summary with its Pareto rows (high lcb, small size), its rank (lcb, size, silhouette) and the recommended row."""
    front = pareto(summary, "lcb", "size").select("k", "b", F.lit(True).alias("pareto"))
    best = select_joint(summary, target, max_size).select("k", "b", F.lit(True).alias("recommended"))
    d = summary.join(front, ["k", "b"], "left").join(best, ["k", "b"], "left")
    rank = F.row_number().over(Window.orderBy(F.desc("lcb"), "size", F.desc_nulls_last("silhouette"), "k", "b"))
    return d.select("*", rank.alias("rank")).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("pareto", "recommended")})


def baseline_min_size(front: DataFrame, target: float, order: list[str], label: str = "generator") -> DataFrame:
    """Per generator, in a given order: the smallest size as text, '>limit' where none meets the target."""
    d = front.groupBy(label).agg(F.min(F.when(F.col("lcb") >= target, F.col("b"))).alias("b"), F.max("b").alias("limit"))
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label))
    return d.select(place.cast("int").alias("place"), label, F.coalesce(F.col("b").cast("string"), F.concat(F.lit(">"), F.col("limit").cast("string"))).alias("size"))
