"""How far subsets are from the population (I): mean gaps, KS distances, events and audits.

Scores are long: unit, regime, method, metric, value. Draws: b, trial, unit. The trial table (one row for each b, trial,
method and metric) answers all events; a draw is part of the population, so its KS distance needs only the population's
distribution at the drawn values, worked out once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import running_counts, running_sums, wilson_lcb

KEY = ["method", "metric"]
TRIAL = ["b", "trial"]  # what tells draws apart; groupings, generators or seeds may come before


def ranked(scores: DataFrame, by: list[str] = KEY) -> DataFrame:
    """scores with f_le and f_lt: shares of the population's values at most, and below, the value."""
    c = running_counts(scores, by)
    return scores.join(c.select(*by, "value", (F.col("le") / F.col("n")).alias("f_le"), (F.col("lt") / F.col("n")).alias("f_lt")), [*by, "value"])


def trial_stats(draws: DataFrame, scores: DataFrame, by: list[str] = KEY, keys: list[str] = TRIAL) -> DataFrame:
    """keys, by, n, mean, pop_mean, gap (absolute), ks."""
    means = scores.groupBy(*by).agg(F.avg("value").alias("pop_mean"))
    return drawn_stats(draws.select(*keys, "unit").join(ranked(scores, by), "unit"), by, keys, means)


def drawn_stats(d: DataFrame, by: list[str], keys: list[str], means: DataFrame | None = None) -> DataFrame:
    """trial_stats of drawn and ranked scores (keys, by, value, f_le, f_lt); without means (by, pop_mean) those that the
    ranks hold, in the column pop_mean."""
    own = Window.partitionBy(*keys, *by)
    d = d.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("lo", F.rank().over(own.orderBy("value")) - 1).withColumn("hi", F.count(F.lit(1)).over(own.orderBy("value")))
    apart = F.greatest(F.abs(F.col("hi") / F.col("n") - F.col("f_le")), F.abs(F.col("f_lt") - F.col("lo") / F.col("n")))
    t = d.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max(apart).alias("ks"), *([F.first("pop_mean").alias("pop_mean")] if means is None else []))
    t = (t if means is None else t.join(means, by)).withColumn("gap", F.round(F.abs(F.col("mean") - F.col("pop_mean")), 9))
    return t.withColumn("ks", F.round("ks", 9)).select(*keys, *by, "n", "mean", "pop_mean", "gap", "ks")


def tolerances(scores: DataFrame, c: float, tau_ks: float) -> DataFrame:
    """method, metric, tau (c sample deviations), tau_ks."""
    return scores.groupBy(*KEY).agg(F.round(c * F.stddev_samp("value"), 9).alias("tau")).withColumn("tau_ks", F.lit(tau_ks))


def constraints(trials: DataFrame, tol: DataFrame, keys: list[str] = TRIAL) -> DataFrame:
    """A row for each trial and constraint: method, metric, kind (mean or ks), amount, ratio to its tolerance, ok."""
    d = trials.join(tol, KEY)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(x).alias("amount"), (F.col(x) / F.col(t)).alias("ratio"), (F.col(x) <= F.col(t)).alias("ok")) for k, x, t in (("mean", "gap", "tau"), ("ks", "ks", "tau_ks"))])
    return d.select(*keys, *KEY, F.explode(kinds).alias("x")).select(*keys, *KEY, "x.*")


def joint_event(rows: DataFrame, keys: list[str] = TRIAL) -> DataFrame:
    """keys, ok (every constraint holds), mean_objective, joint_objective (largest ratios), max_ks."""
    mean, ks = F.max(F.when(F.col("kind") == "mean", F.col("ratio"))), F.max(F.when(F.col("kind") == "ks", F.col("amount")))
    return rows.groupBy(*keys).agg(F.every("ok").alias("ok"), F.round(mean, 9).alias("mean_objective"), F.round(F.max("ratio"), 9).alias("joint_objective"), ks.alias("max_ks"))


def method_pass(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("b", "trial", "method").agg(F.every("ok").alias("ok"))
    return per.groupBy("b", "method").agg(F.count_if("ok").alias("n_pass"), F.count(F.lit(1)).alias("n_trials"))


def binding_histogram(rows: DataFrame) -> DataFrame:
    """Over failing trials: how often each constraint doesn't hold."""
    return rows.filter(~F.col("ok")).groupBy("b", "method", "metric", "kind").agg(F.count(F.lit(1)).alias("n_fail"))


def mean_gaps(scores: DataFrame, subset: DataFrame, by: list[str] = KEY) -> DataFrame:
    """Population and subset counts and means, the signed and absolute gap, and the gap in percent."""
    d = scores.join(subset.select("unit").distinct().withColumn("inside", F.lit(True)), "unit", "left")
    inside = F.when(F.col("inside"), F.col("value"))
    g = d.groupBy(*by).agg(F.count("value").alias("n_pop"), F.count(inside).alias("n_subset"), F.avg("value").alias("pop_mean"), F.avg(inside).alias("subset_mean"))
    gap = F.col("subset_mean") - F.col("pop_mean")
    return g.withColumn("gap", gap).withColumn("abs_gap", F.abs(gap)).withColumn("rel_gap_pct", F.when(F.col("pop_mean") != 0, 100 * gap / F.abs("pop_mean")))


def ks_distance(df: DataFrame, by: list[str], value: str = "value", side: str = "side") -> DataFrame:
    """by, n_a, n_b, ks: the two-sample distance between rows with side true and false."""
    d = df.filter(F.col(value).isNotNull() & F.col(side).isNotNull())
    c = d.groupBy(*by, value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    c = running_sums(c, by, value, ["a", "b"])
    n = d.groupBy(*by).agg(F.count_if(F.col(side)).alias("n_a"), F.count_if(~F.col(side)).alias("n_b"))
    c = c.join(n, by) if by else c.crossJoin(n)
    return c.groupBy(*by, "n_a", "n_b").agg(F.round(F.max(F.abs(F.col("upto_a") / F.col("n_a") - F.col("upto_b") / F.col("n_b"))), 9).alias("ks"))


def regime_breakdown(scores: DataFrame, subset: DataFrame, tol: DataFrame) -> DataFrame:
    """Per regime, method and metric: gap, KS (two values on each side at least), whether both are within tolerance."""
    by = ["regime", *KEY]
    gaps = mean_gaps(scores, subset, by)
    inside = scores.join(subset.select("unit").distinct(), "unit", "left_semi")
    sides = scores.withColumn("side", F.lit(False)).unionByName(inside.withColumn("side", F.lit(True)))
    ks = ks_distance(sides, by).select(*by, F.when((F.col("n_a") >= 2) & (F.col("n_b") >= 2), F.col("ks")).alias("ks"))
    d = gaps.join(ks, by).join(tol, KEY)
    gap = F.round("abs_gap", 9)
    ok = (gap <= F.col("tau")) & (F.col("ks") <= F.col("tau_ks"))
    return d.select(*by, "n_pop", "n_subset", gap.alias("abs_gap"), "ks", F.coalesce(ok, F.lit(False)).alias("within"), F.round(gap / F.col("tau"), 9).alias("discrepancy"))


def regime_summary(breakdown: DataFrame) -> DataFrame:
    """Per method and metric: mean gap over regimes, regimes within tolerance, the worst regime."""
    worst = F.max_by("regime", F.struct("abs_gap", "regime"))
    return breakdown.groupBy(*KEY).agg(F.round(F.avg("abs_gap"), 6).alias("mean_abs_gap"), F.count_if("within").alias("n_within"), F.count(F.lit(1)).alias("n_regimes"), worst.alias("worst_regime"))


def check_thresholds(gaps: DataFrame, breakdown: DataFrame, tol: DataFrame) -> DataFrame:
    """Per method and metric: the global gap, and the worst regime's, against the tolerance and twice it; no rows fail."""
    worst = breakdown.groupBy(*KEY).agg(F.max("abs_gap").alias("worst_gap"))
    d = tol.join(gaps.select(*KEY, "abs_gap"), KEY, "left").join(worst, KEY, "left")
    global_ok = F.coalesce(F.round("abs_gap", 9) <= F.col("tau"), F.lit(False))
    return d.select(*KEY, global_ok.alias("global_ok"), F.coalesce(F.col("worst_gap") <= 2 * F.col("tau"), F.lit(False)).alias("regime_ok"))


def regime_event(regime_trials: DataFrame, events: DataFrame, tol: DataFrame, cs: list[float]) -> DataFrame:
    """b, trial, c, ok: the global event, and the largest gap/tolerance over regimes and metrics at most c."""
    r = regime_trials.join(tol, KEY).groupBy("b", "trial").agg(F.max(F.col("gap") / F.col("tau")).alias("worst"))
    d = events.join(r, ["b", "trial"])
    return d.select("b", "trial", F.explode(F.array(*[F.lit(float(c)) for c in cs])).alias("c"), "ok", "worst").select("b", "trial", "c", (F.col("ok") & (F.round("worst", 9) <= F.col("c"))).alias("ok"))


def method_pairs(means: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, a, b_method, diff for each two methods of `means` (keys, method, metric, mean)."""
    a, b = means.alias("a"), means.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "metric"]]
    d = a.join(b, on).filter("a.method < b.method")
    return d.select(*[F.col(f"a.{k}") for k in [*keys, "metric"]], F.col("a.method").alias("first"), F.col("b.method").alias("second"), (F.col("a.mean") - F.col("b.mean")).alias("diff"))


def ranking_event(trials: DataFrame, scores: DataFrame, events: DataFrame, tol: DataFrame, keys: list[str] = TRIAL) -> DataFrame:
    """events with keeps_order (A: the sign of every method gap) and keeps_gap (B: and it is within the larger tolerance)."""
    pop = method_pairs(scores.groupBy(*KEY).agg(F.avg("value").alias("mean")), []).withColumnRenamed("diff", "pop_diff")
    own = method_pairs(trials.select(*keys, *KEY, "mean"), keys)
    pair_tol = pop.join(tol.select(F.col("method").alias("first"), "metric", F.col("tau").alias("t1")), ["first", "metric"]).join(tol.select(F.col("method").alias("second"), "metric", F.col("tau").alias("t2")), ["second", "metric"])
    d = own.join(pair_tol, ["first", "second", "metric"])
    a = F.signum(F.round("diff", 9)) == F.signum(F.round("pop_diff", 9))
    b = F.round(F.abs(F.col("diff") - F.col("pop_diff")), 9) <= F.greatest("t1", "t2")
    d = d.groupBy(*keys).agg(F.every(a).alias("keeps_order"), F.every(a & b).alias("keeps_gap"))
    return events.join(d, keys)


def ranking_rates(rows: DataFrame) -> DataFrame:
    rate = lambda c: F.round(F.avg(c.cast("int")), 9)
    ok, a, b = F.col("ok"), F.col("keeps_order"), F.col("keeps_gap")
    return rows.groupBy("b").agg(F.count(F.lit(1)).alias("n_trials"), rate(a).alias("order_rate"), rate(b).alias("gap_rate"), F.count_if(ok & a).alias("n_joint_order"), F.count_if(ok & b).alias("n_joint_gap"), F.round(F.avg(F.when(ok, a.cast("int"))), 9).alias("order_given_joint"))


def simulate_budget(draws: DataFrame, wide: DataFrame, tol: dict[str, float], runtime_weight: float, keys: list[str] = TRIAL) -> DataFrame:
    """Per trial of draws: gaps of the metrics in tol, mean runtime, the sum of gaps over tolerances plus the weighted ratio
    of the draw's mean runtime to that of all, and a pass flag.

    `wide` has unit, the metrics and runtime (nullable; where the ratio isn't known it doesn't count).
    """
    pop = wide.agg(*[F.avg(m).alias(f"pop_{m}") for m in tol], F.avg("runtime").alias("pop_runtime"))
    t = draws.join(wide, "unit").groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), *[F.avg(m).alias(m) for m in tol], F.avg("runtime").alias("run")).crossJoin(F.broadcast(pop))  # one row
    gap = lambda m: F.round(F.abs(F.col(m) - F.col(f"pop_{m}")), 9)
    ratio = F.coalesce(F.when(F.col("pop_runtime") > 1e-12, F.greatest(F.lit(0.0), F.col("run") / F.col("pop_runtime"))), F.lit(0.0))
    total = sum((gap(m) / F.lit(x) for m, x in tol.items()), runtime_weight * ratio)
    ok = F.lit(True)
    for m, x in tol.items():
        ok = ok & (gap(m) <= x)
    return t.select(*keys, "units", *[gap(m).alias(f"gap_{m}") for m in tol], F.round("run", 9).alias("runtime_mean"), F.round(total, 6).alias("objective"), ok.alias("ok"))


def budget_summary(sim: DataFrame, draws: DataFrame, pop: DataFrame, wide: DataFrame, tol: dict[str, float], regime_tol: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Per budget (and `by`): trials, passes, rate and bound, expected and 95 % gaps and runtimes, and of the best draw
    (objective, then trial) its runtime, whether it passes, its largest gap of a regime, and whether all regimes pass.

    sim: as simulate_budget returns it for draws; pop: unit, regime and `by`; gaps of regimes are held against regime_tol.
    """
    g = [*by, "b"]
    q = lambda c: F.round(F.percentile(c, F.lit(0.95)), 6)  # noqa: E731  over trials
    best = F.min(F.struct("objective", "trial", "ok", "runtime_mean", "units"))
    s = sim.groupBy(*g).agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("ok").alias("n_pass"), *[x for m in tol for x in (F.round(F.avg(f"gap_{m}"), 6).alias(f"exp_gap_{m}"), q(f"gap_{m}").alias(f"p95_gap_{m}"))], F.round(F.avg("runtime_mean"), 6).alias("exp_runtime"), q("runtime_mean").alias("p95_runtime"), best.alias("x"))
    s = s.select(*g, F.col("x.units").alias("size"), "n_trials", "n_pass", F.round(F.col("n_pass") / F.col("n_trials"), 9).alias("rate"), F.round(wilson_lcb(F.col("n_pass"), F.col("n_trials")), 9).alias("lcb"),
                 *[f"{k}_gap_{m}" for m in tol for k in ("exp", "p95")], "exp_runtime", "p95_runtime", F.col("x.trial").alias("best_trial"), F.col("x.objective").alias("best_objective"), F.round("x.runtime_mean", 6).alias("best_runtime"), F.col("x.ok").alias("best_pass"))
    full = pop.join(wide, "unit").groupBy(*by, "regime").agg(*[F.avg(m).alias(f"full_{m}") for m in tol])
    own = draws.join(s.select(*g, F.col("best_trial").alias("trial")), [*g, "trial"], "left_semi").join(wide, "unit").groupBy(*g, "regime").agg(*[F.avg(m).alias(m) for m in tol])
    worst = own.join(full, [*by, "regime"]).groupBy(*g).agg(*[F.round(F.max(F.abs(F.col(m) - F.col(f"full_{m}"))), 9).alias(f"regime_gap_{m}") for m in tol])
    ok = F.lit(True)
    for m, x in regime_tol.items():
        ok = ok & (F.col(f"regime_gap_{m}") <= x)
    return s.join(worst, g).withColumn("best_regime_pass", ok)


def random_baseline(trials: DataFrame, observed: DataFrame) -> DataFrame:
    """For an observed gap per method and metric: mean, deviation, 2.5 and 97.5 quantiles of the draws' signed gaps, the
    share at most the observed one, and the two-sided p. Trials are few for each row, so quantiles are plain aggregates."""
    d = trials.withColumn("signed", F.round(F.col("mean") - F.col("pop_mean"), 9)).join(observed.select(*KEY, F.round("gap", 9).alias("observed")), KEY)
    below = F.avg((F.col("signed") <= F.col("observed")).cast("int"))
    far = F.avg((F.abs("signed") >= F.abs("observed")).cast("int"))
    q = lambda p: F.round(F.percentile("signed", F.lit(p)), 6)
    return d.groupBy("b", *KEY, "observed").agg(F.round(F.avg("signed"), 6).alias("mean"), F.round(F.stddev_samp("signed"), 6).alias("sd"), q(0.025).alias("q025"), q(0.975).alias("q975"), F.round(100 * below, 6).alias("percentile"), F.round(far, 6).alias("p_two_sided"))


def random_percentile(trials: DataFrame, observed: DataFrame) -> DataFrame:
    """b, the average over methods and metrics of the share of draws whose gap is below the observed one."""
    d = trials.join(observed.select(*KEY, F.round("abs_gap", 9).alias("observed")), KEY)
    per = d.groupBy("b", *KEY).agg(F.avg((F.col("gap") < F.col("observed")).cast("int")).alias("share"))
    return per.groupBy("b").agg(F.round(100 * F.avg("share"), 6).alias("percentile"))


def audit_subset(scores: DataFrame, subset: DataFrame, tol: DataFrame) -> DataFrame:
    """One row: units asked and found, constraints that don't hold, as an ordered list, and the verdict."""
    one = subset.select(F.lit(0).alias("b"), F.lit(0).alias("trial"), "unit").distinct()
    rows = constraints(trial_stats(one, scores), tol)
    name = F.concat_ws(":", "method", "metric", "kind")
    found = rows.agg(F.array_sort(F.collect_list(F.when(~F.col("ok"), name))).alias("violated"))
    counts = one.agg(F.count(F.lit(1)).alias("n_asked")).crossJoin(one.join(scores.select("unit").distinct(), "unit", "left_semi").agg(F.count(F.lit(1)).alias("n_found")))
    return counts.crossJoin(found).select("n_asked", "n_found", F.size("violated").alias("n_violated"), F.array_join("violated", ",").alias("violated"), (F.size("violated") == 0).alias("ok"))


def calibration(scores: DataFrame, tol: DataFrame) -> DataFrame:
    """Per metric: the largest tolerance over sigma, the smallest gap between two methods' means, tolerance below it."""
    s = scores.groupBy(*KEY).agg(F.stddev_samp("value").alias("sigma"), F.avg("value").alias("mean"))
    gap = method_pairs(s.select(*KEY, "mean"), []).groupBy("metric").agg(F.min(F.round(F.abs("diff"), 9)).alias("smallest_gap"))
    d = s.join(tol, KEY).groupBy("metric").agg(F.round(F.max(F.col("tau") / F.col("sigma")), 6).alias("tau_over_sigma"), F.max("tau").alias("tau"))
    return d.join(gap, "metric").select("metric", "tau_over_sigma", "smallest_gap", (F.col("tau") < F.col("smallest_gap")).alias("below_gap"))
