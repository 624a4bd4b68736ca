"""Queries over parts as units, their type as regime, and line items by return flag as methods (H, I, J)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ks_critical, union_all, unpivot, wilson_lcb
from ..operators import fidelity as fi
from ..operators import reliability as re_
from ..operators import sampling as sa
from ..sources.tables import load, scratch, stored
from ..sources.trials import TrialStore

BUDGETS, TRIALS, SEED = [4, 8, 16], 400, 7
SWEEP = [4, 6, 8, 10, 12, 14, 16, 20]  # budgets of a full sweep
TAU_C, TAU_KS = 0.2, 0.14
TARGETS = [0.2, 0.5, 0.8]
SETS = {"strict": (0.5, 0.8), "default": (1.0, 1.0), "relaxed": (2.0, 1.5)}
MEANS, KSS = [0.5, 1.0, 1.5, 2.0], [0.8, 1.0, 1.2, 1.5]

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# ---- the inputs, here and in SQL


def wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    r = lambda c, by=1: F.round(F.avg(c) / by, 9)
    return li.groupBy(F.col("l_partkey").alias("unit"), F.col("l_returnflag").alias("method")).agg(r("l_extendedprice", 1000).alias("price"), r("l_discount").alias("disc"), r("l_quantity").alias("qty"))


def raw_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = unpivot(wide_scores(spark, sf), ["unit", "method"], ["price", "disc", "qty"], "metric")
    regimes = load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("regime"))
    return s.join(regimes, "unit").select("unit", "regime", "method", "metric", "value")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of units that every method has. Line items are read once; what follows is worked out of the means."""
    regimes = load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("regime"))
    w = stored(wide_scores(spark, sf).join(regimes, "unit"), "means")
    methods = w.select("method").distinct().count()
    common = w.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == methods)
    s = unpivot(w.join(common.select("unit"), "unit", "left_semi"), ["unit", "regime", "method"], ["price", "disc", "qty"], "metric")
    return stored(s, "scores")


def population(s: DataFrame) -> DataFrame:
    return s.select("unit", "regime").distinct()


BASE = """
sc AS (SELECT l_partkey AS unit, l_returnflag AS method, round(avg(l_extendedprice) / 1000, 9) AS price,
              round(avg(l_discount), 9) AS disc, round(avg(l_quantity), 9) AS qty FROM lineitem GROUP BY ALL),
raw AS (SELECT unit, p_type AS regime, method, metric, value FROM
        (SELECT unit, method, 'price' AS metric, price AS value FROM sc UNION ALL SELECT unit, method, 'disc', disc FROM sc
         UNION ALL SELECT unit, method, 'qty', qty FROM sc) JOIN part ON p_partkey = unit),
scores AS (SELECT * FROM raw WHERE unit IN (SELECT unit FROM raw GROUP BY unit HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM raw))),
pop AS (SELECT DISTINCT unit, regime FROM scores),
sz AS (SELECT regime, count(*) AS n FROM pop GROUP BY regime)"""


def draws_sql(alloc: str, name: str = "draws", pop: str = "pop", trials: int = TRIALS, seed: int = SEED) -> str:
    p = name
    return f"""
{p}_placed AS (SELECT unit, regime, row_number() OVER (PARTITION BY regime ORDER BY md5(unit::VARCHAR), unit) - 1 AS pos FROM {pop}),
{p}_sz AS (SELECT regime, count(*) AS n FROM {pop} GROUP BY regime),
{p}_al AS (SELECT a.b, a.regime, a.take, coalesce(n, 0) AS n, max(CASE WHEN take < 1 OR take > coalesce(n, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY b) AS bad
           FROM {alloc} a LEFT JOIN {p}_sz USING (regime)),
{p}_tr AS (SELECT b, regime, take, n, trial, unnest(range(0, CASE WHEN n < 2 * take THEN n ELSE 4 * take + 41 END)) AS j
           FROM (SELECT *, unnest(range(0, {trials})) AS trial FROM {p}_al WHERE bad = 0)),
{p}_hh AS (SELECT *, ('0x' || substr(md5(concat_ws('|', ({seed} + b)::VARCHAR, trial::VARCHAR, regime, j::VARCHAR)), 1, 12))::BIGINT AS h FROM {p}_tr),
{p}_pf AS (SELECT b, regime, take, trial, CASE WHEN n < 2 * take THEN j ELSE h % n END AS pos, min(CASE WHEN n < 2 * take THEN h ELSE j END) AS ord, min(j) AS j
           FROM {p}_hh GROUP BY ALL),
{p}_pk AS (SELECT *, row_number() OVER (PARTITION BY b, regime, trial ORDER BY ord, j) AS rn FROM {p}_pf),
{name} AS (SELECT b, trial, unit, regime FROM {p}_pk JOIN {p}_placed USING (regime, pos) WHERE rn <= take)"""


_B = "[" + ", ".join(map(str, BUDGETS)) + "]"
EQUAL = f"equal AS (SELECT unnest({_B}) AS b, regime FROM sz), alloc AS (SELECT b, regime, b AS take FROM equal)"
PROPORTIONAL = f"""
f AS (SELECT unnest({_B}) AS b, regime, n FROM sz),
x AS (SELECT b, regime, b * count(*) OVER (PARTITION BY b) AS total, b * count(*) OVER (PARTITION BY b) * n::DOUBLE / sum(n) OVER (PARTITION BY b) AS exact FROM f),
y AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(exact - floor(exact), 9) DESC, regime) AS place, total - sum(floor(exact)) OVER (PARTITION BY b) AS spare FROM x),
prop AS (SELECT b, regime, (floor(exact) + CASE WHEN place <= spare THEN 1 ELSE 0 END)::INT AS take FROM y)"""
TRIAL = """
rk AS (SELECT *, cume_dist() OVER (PARTITION BY method, metric ORDER BY value) AS f_le,
              (rank() OVER (PARTITION BY method, metric ORDER BY value) - 1)::DOUBLE / count(*) OVER (PARTITION BY method, metric) AS f_lt FROM scores),
pm AS (SELECT method, metric, avg(value) AS pop_mean FROM scores GROUP BY ALL)"""


def trials_sql(draws: str = "draws", name: str = "trials") -> str:
    return f"""
{name}_d AS (SELECT d.b, d.trial, r.method, r.metric, r.value, f_le, f_lt, count(*) OVER (PARTITION BY d.b, d.trial, r.method, r.metric) AS n,
             rank() OVER (PARTITION BY d.b, d.trial, r.method, r.metric ORDER BY r.value) - 1 AS lo,
             count(*) OVER (PARTITION BY d.b, d.trial, r.method, r.metric ORDER BY r.value) AS hi FROM {draws} d JOIN rk r USING (unit)),
{name} AS (SELECT b, trial, method, metric, count(*) AS n, avg(value) AS mean, pop_mean, round(abs(avg(value) - pop_mean), 9) AS gap,
           round(max(greatest(abs(hi::DOUBLE / n - f_le), abs(f_lt - lo::DOUBLE / n))), 9) AS ks FROM {name}_d JOIN pm USING (method, metric) GROUP BY b, trial, method, metric, pop_mean)"""


TOL = f"tol AS (SELECT method, metric, round({TAU_C} * stddev_samp(value), 9) AS tau, {TAU_KS}::DOUBLE AS tau_ks FROM scores GROUP BY ALL)"


def cons_sql(trials: str = "trials", name: str = "cons") -> str:
    return f"""
{name} AS (SELECT b, trial, method, metric, 'mean' AS kind, gap AS amount, gap / tau AS ratio, gap <= tau AS ok FROM {trials} JOIN tol USING (method, metric)
           UNION ALL SELECT b, trial, method, metric, 'ks', ks, ks / tau_ks, ks <= tau_ks FROM {trials} JOIN tol USING (method, metric))"""


EVENT = "bool_and(ok) AS ok, round(max(ratio) FILTER (kind = 'mean'), 9) AS mean_objective, round(max(ratio), 9) AS joint_objective, max(amount) FILTER (kind = 'ks') AS max_ks"


def events_sql(cons: str = "cons", name: str = "ev", where: str = "true") -> str:
    return f"""
{name} AS (SELECT b, trial, {EVENT} FROM {cons} WHERE {where} GROUP BY b, trial)"""


WILSON = "CASE WHEN {n} > 0 THEN greatest(0, ({k}::DOUBLE / {n} + 3.8414588206941236 / (2 * {n}) - 1.959963984540054 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 3.8414588206941236 / (4 * {n} * {n}))) / (1 + 3.8414588206941236 / {n})) ELSE 0 END"


def frontier_sql(events: str = "ev", name: str = "fr", by: str = "") -> str:
    by = f"{by}, " if by else ""
    return f"""
{name} AS (SELECT {by}b, count(*) AS n_trials, count(*) FILTER (ok) AS n_pass, round(count(*) FILTER (ok)::DOUBLE / count(*), 9) AS rate,
           round({WILSON.format(k="count(*) FILTER (ok)", n="count(*)")}, 9) AS lcb,
           min_by(trial, [joint_objective, mean_objective, trial::DOUBLE]) AS best_trial, min(joint_objective) AS best_joint,
           min_by(mean_objective, [joint_objective, mean_objective, trial::DOUBLE]) AS best_mean, min_by(max_ks, [joint_objective, mean_objective, trial::DOUBLE]) AS best_max_ks FROM {events} GROUP BY {by}b)"""


def worked_out_once(text: str, *names: str) -> str:
    """SQL whose common table expressions of these names are materialised."""
    for name in names:
        text = re.sub(rf"\b{name} AS \(", f"{name} AS MATERIALIZED (", text)
    return text


def sql(*parts: str) -> str:
    """All parts but the last are common table expressions."""
    return "WITH " + ", ".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


DRAWN = [BASE, EQUAL, draws_sql("alloc")]
TRIED = [*DRAWN, TRIAL, trials_sql(), TOL, cons_sql(), events_sql()]
FRONT = [*TRIED, frontier_sql()]


class Audit:
    """The inputs of a query, each worked out once."""

    def __init__(self, spark: SparkSession, sf: str):
        self.scores = scores(spark, sf)
        self.pop = population(self.scores)

    def drawn(self) -> DataFrame:
        return sa.draw_balanced(self.pop, BUDGETS, TRIALS, SEED)

    def trials(self) -> DataFrame:
        return fi.trial_stats(self.drawn(), self.scores)

    def tol(self) -> DataFrame:
        return fi.tolerances(self.scores, TAU_C, TAU_KS)

    def cons(self, method: str | None = None) -> DataFrame:
        c = fi.constraints(self.trials(), self.tol())
        return c.filter(F.col("method") == method) if method else c

    def events(self, method: str | None = None) -> DataFrame:
        return fi.joint_event(self.cons(method))

    def subset(self) -> DataFrame:
        return self.drawn().filter("b = 16 and trial = 0").select("unit", "regime")


SUB = "sub AS (SELECT unit, regime FROM draws WHERE b = 16 AND trial = 0)"


# ---- H


@query("h1_draw_balanced", sql(*DRAWN, "SELECT * FROM draws"))
def h1(spark, sf):
    return Audit(spark, sf).drawn()


UNIFORM = [
    "one AS (SELECT unit, 'all' AS regime FROM pop)",
    f"ualloc AS (SELECT unnest({_B}) AS b, 'all' AS regime, unnest({_B}) * (SELECT count(*) FROM sz) AS take)",
    draws_sql("ualloc", "udraws", "one", TRIALS, SEED + 10000),
]


@query("h2_draw_uniform", sql(BASE, *UNIFORM, "SELECT b, trial, unit, pop.regime FROM udraws JOIN pop USING (unit)"))
def h2(spark, sf):
    return sa.draw_uniform(Audit(spark, sf).pop, BUDGETS, TRIALS, SEED).select("b", "trial", "unit", "regime")


@query("h3_allocate_proportional", sql(BASE, PROPORTIONAL, "SELECT b, regime, take FROM prop"))
def h3(spark, sf):
    return sa.allocate_proportional(Audit(spark, sf).pop, BUDGETS)


@query("h4_draw_allocated", sql(BASE, PROPORTIONAL, draws_sql("prop"), "SELECT * FROM draws"))
def h4(spark, sf):
    pop = Audit(spark, sf).pop
    return sa.draw_allocated(pop, sa.allocate_proportional(pop, BUDGETS), TRIALS, SEED)


GRID = [12, 15, 24, 48, 96, 3000]


@query("h5_budget_grid", sql(BASE, f"k AS (SELECT count(*) AS k, min(n) AS smallest FROM sz), g AS (SELECT unnest({GRID}) AS size, k, smallest FROM k)", """
SELECT greatest(1, floor(size::DOUBLE / k + 0.5))::INT AS b, min(size) AS size, greatest(1, floor(size::DOUBLE / k + 0.5))::INT * k AS units,
       greatest(1, floor(size::DOUBLE / k + 0.5)) <= smallest AS feasible,
       CASE WHEN greatest(1, floor(size::DOUBLE / k + 0.5)) > smallest THEN 'smallest regime is below b' END AS reason FROM g GROUP BY ALL"""))
def h5(spark, sf):
    return sa.budget_grid(Audit(spark, sf).pop, GRID)


@query("h6_stratified_split", sql(BASE, f"""
s AS (SELECT unit, regime, n, row_number() OVER (PARTITION BY regime ORDER BY md5('{SEED}|' || unit::VARCHAR), '{SEED}|' || unit::VARCHAR) - 1 AS pos FROM pop JOIN sz USING (regime))""", """
SELECT unit, regime, CASE WHEN pos < round_even(n * 0.6, 0) THEN 'selection' WHEN pos < round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'tune' ELSE 'test' END AS split FROM s"""))
def h6(spark, sf):
    return sa.stratified_split(Audit(spark, sf).pop, 0.6, 0.2, SEED)


@query("h7_paired_draws", sql(*TRIED, "SELECT a.b, count(*) AS n_trials, count(*) FILTER (a.ok) AS n_single, count(*) FILTER (ev.ok) AS n_joint, count(*) FILTER (ev.ok AND NOT a.ok) AS n_odd FROM (SELECT b, trial, bool_and(ok) AS ok FROM cons WHERE method = 'R' GROUP BY ALL) a JOIN ev USING (b, trial) GROUP BY a.b"))
def h7(spark, sf):
    """The same draws under two events: a trial that passes jointly passes for one method."""
    cons = stored(Audit(spark, sf).cons(), "constraints")
    one, all_ = fi.joint_event(cons.filter("method = 'R'")), fi.joint_event(cons)
    d = one.select("b", "trial", F.col("ok").alias("one")).join(all_.select("b", "trial", "ok"), ["b", "trial"])
    return d.groupBy("b").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("one").alias("n_single"), F.count_if("ok").alias("n_joint"), F.count_if(F.col("ok") & ~F.col("one")).alias("n_odd"))


STORED = " UNION ALL ".join(f"SELECT '{event}' AS event, {hit} AS hit, b, count(*) AS n_trials, count(*) FILTER (ok) AS n_pass, round(avg(joint_objective), 6) AS mean_joint FROM (SELECT b, trial, {EVENT} FROM cons WHERE {where} GROUP BY b, trial) GROUP BY b" for event, hit, where in (("one method", "false", "method = 'R'"), ("all methods", "true", "true"), ("changed input", "false", "method <> 'A'")))


@query("h7_trial_store", sql(*TRIED[:-1], STORED))
def h7_store(spark, sf):
    """Three audits by one store: the first event draws and fills it, the second one, other constraints on the same trials,
    reads what the first left, and scores without one of the methods aren't found in it."""
    a = Audit(spark, sf)
    store, alloc = TrialStore(spark, scratch(spark, "trials")), sa.allocate_equal(a.pop, BUDGETS)
    out = []
    for event, scores_, method in (("one method", a.scores, "R"), ("all methods", a.scores, None), ("changed input", a.scores.filter("method <> 'A'"), None)):
        entry = store.get(scores_, alloc, TRIALS, SEED)
        cons = fi.constraints(entry.trials, a.tol())
        ev = fi.joint_event(cons.filter(F.col("method") == method) if method else cons)
        summed = ev.groupBy("b").agg(F.count(F.lit(1)).alias("n_trials"), F.count_if("ok").alias("n_pass"), F.round(F.avg("joint_objective"), 6).alias("mean_joint"))
        out.append(summed.select(F.lit(event).alias("event"), F.lit(entry.hit).alias("hit"), "b", "n_trials", "n_pass", "mean_joint"))
    return union_all(out)


# ---- I

GAPS = """
gaps AS (SELECT method, metric, count(value) AS n_pop, count(s.unit) AS n_subset, avg(value) AS pop_mean, avg(value) FILTER (s.unit IS NOT NULL) AS subset_mean
         FROM scores LEFT JOIN sub s USING (unit) GROUP BY ALL)"""
_R9 = lambda c: f"round({c}, 9) AS {c}"


def _gap_cols(by):
    return [*by, "n_pop", "n_subset", *[F.round(c, 6).alias(c) for c in ("pop_mean", "subset_mean", "gap", "abs_gap", "rel_gap_pct")]]


_GAPS6 = "n_pop, n_subset, round(pop_mean, 6) AS pop_mean, round(subset_mean, 6) AS subset_mean, round(subset_mean - pop_mean, 6) AS gap, round(abs(subset_mean - pop_mean), 6) AS abs_gap, round(100 * (subset_mean - pop_mean) / abs(pop_mean), 6) AS rel_gap_pct"


@query("i1_mean_gaps", sql(*DRAWN, SUB, GAPS, f"SELECT method, metric, {_GAPS6} FROM gaps"))
def i1(spark, sf):
    a = Audit(spark, sf)
    return fi.mean_gaps(a.scores, a.subset()).select(*_gap_cols(fi.KEY))


def ks_sql(by: str) -> str:
    return f"""
kv AS (SELECT {by}, value, s.unit IS NOT NULL AS side FROM scores LEFT JOIN sub s USING (unit, regime) UNION ALL SELECT {by}, value, NULL FROM scores WHERE false),
kc AS (SELECT {by}, value, count(*) FILTER (side) AS a, count(*) AS p FROM kv GROUP BY ALL),
kr AS (SELECT {by}, sum(a) OVER (PARTITION BY {by} ORDER BY value) AS ua, sum(p) OVER (PARTITION BY {by} ORDER BY value) AS up,
              sum(a) OVER (PARTITION BY {by}) AS na, sum(p) OVER (PARTITION BY {by}) AS np FROM kc),
ks AS (SELECT {by}, any_value(na)::BIGINT AS n_a, any_value(np)::BIGINT AS n_b, round(max(abs(ua::DOUBLE / na - up::DOUBLE / np)), 9) AS ks FROM kr GROUP BY {by})"""


@query("i2_ks_distance", sql(*DRAWN, SUB, ks_sql("method, metric"), "SELECT method, metric, n_a, n_b, ks FROM ks"))
def i2(spark, sf):
    a = Audit(spark, sf)
    inside = a.scores.join(a.subset().select("unit"), "unit", "left_semi")
    return fi.ks_distance(inside.withColumn("side", F.lit(True)).unionByName(a.scores.withColumn("side", F.lit(False))), fi.KEY)


@query("i3_single_event", sql(*TRIED[:-1], events_sql(where="method = 'R'"), "SELECT * FROM ev"))
def i3(spark, sf):
    return Audit(spark, sf).events("R")


RUNTIME = "rt AS (SELECT l_partkey AS unit, round(avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), 9) AS runtime FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


def runtime(spark, sf) -> DataFrame:
    d = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return d.groupBy(F.col("l_partkey").alias("unit")).agg(F.round(F.avg(F.datediff("l_shipdate", "o_orderdate")), 9).alias("runtime"))


WIDE = "wide AS (SELECT s.unit, price, qty, runtime FROM (SELECT DISTINCT unit FROM scores) s JOIN sc ON sc.unit = s.unit AND sc.method = 'R' LEFT JOIN rt ON rt.unit = s.unit)"
SIM_TOL = {"price": 2.0, "qty": 2.5}


def wide_r(a: Audit, spark, sf) -> DataFrame:
    w = wide_scores(spark, sf).filter("method = 'R'").select("unit", "price", "qty")
    return a.pop.select("unit").join(w, "unit").join(runtime(spark, sf), "unit", "left")


def sim_sql(name: str = "sim", draws: str = "draws") -> str:
    return f"""
{name} AS (SELECT b, trial, count(*) AS units, round(abs(avg(price) - (SELECT avg(price) FROM wide)), 9) AS gap_price, round(abs(avg(qty) - (SELECT avg(qty) FROM wide)), 9) AS gap_qty,
        round(avg(runtime), 9) AS runtime_mean,
        round(round(abs(avg(price) - (SELECT avg(price) FROM wide)), 9) / 2.0 + round(abs(avg(qty) - (SELECT avg(qty) FROM wide)), 9) / 2.5 + 0.1 * coalesce(greatest(0, avg(runtime) / (SELECT avg(runtime) FROM wide)), 0), 6) AS objective,
        round(abs(avg(price) - (SELECT avg(price) FROM wide)), 9) <= 2.0 AND round(abs(avg(qty) - (SELECT avg(qty) FROM wide)), 9) <= 2.5 AS ok
        FROM {draws} JOIN wide USING (unit) GROUP BY b, trial)"""


SIM = [*DRAWN, RUNTIME, WIDE, sim_sql()]


@query("i4_simulate_budget", sql(*SIM, "SELECT * FROM sim"))
def i4(spark, sf):
    a = Audit(spark, sf)
    return fi.simulate_budget(a.drawn(), wide_r(a, spark, sf), SIM_TOL, 0.1)


REGIME_TOL = {"price": 8.0, "qty": 8.0}


def summary_sql(name: str = "su", sim: str = "sim", draws: str = "draws") -> list[str]:
    """The summary of a simulation, its best draws' regimes included."""
    best = "min_by({}, [objective, trial::DOUBLE])"
    return [
        f"{name}_a AS (SELECT b, {best.format('units')} AS size, count(*) AS n_trials, count(*) FILTER (ok) AS n_pass, round(count(*) FILTER (ok)::DOUBLE / count(*), 9) AS rate, round({WILSON.format(k='count(*) FILTER (ok)', n='count(*)')}, 9) AS lcb, "
        + ", ".join(f"round(avg(gap_{m}), 6) AS exp_gap_{m}, round(quantile_cont(gap_{m}, 0.95), 6) AS p95_gap_{m}" for m in SIM_TOL)
        + f", round(avg(runtime_mean), 6) AS exp_runtime, round(quantile_cont(runtime_mean, 0.95), 6) AS p95_runtime, {best.format('trial')} AS best_trial, min(objective) AS best_objective, round({best.format('runtime_mean')}, 6) AS best_runtime, {best.format('ok')} AS best_pass FROM {sim} GROUP BY b)",
        f"{name}_f AS (SELECT regime, avg(price) AS price, avg(qty) AS qty FROM pop JOIN wide USING (unit) GROUP BY regime)",
        f"{name}_o AS (SELECT d.b, d.regime, avg(price) AS price, avg(qty) AS qty FROM {draws} d JOIN {name}_a a ON d.b = a.b AND d.trial = a.best_trial JOIN wide USING (unit) GROUP BY d.b, d.regime)",
        f"{name} AS (SELECT {name}_a.*, w.regime_gap_price, w.regime_gap_qty, w.regime_gap_price <= 8.0 AND w.regime_gap_qty <= 8.0 AS best_regime_pass FROM {name}_a JOIN (SELECT o.b, round(max(abs(o.price - f.price)), 9) AS regime_gap_price, round(max(abs(o.qty - f.qty)), 9) AS regime_gap_qty FROM {name}_o o JOIN {name}_f f USING (regime) GROUP BY o.b) w USING (b))",
    ]


@query("i4_budget_summary", sql(*SIM, *summary_sql(), "SELECT * FROM su"))
def i4_summary(spark, sf):
    a = Audit(spark, sf)
    draws, wide = stored(a.drawn(), "draws"), stored(wide_r(a, spark, sf), "wide")
    return fi.budget_summary(fi.simulate_budget(draws, wide, SIM_TOL, 0.1), draws, a.pop, wide, SIM_TOL, REGIME_TOL)


RGAPS = GAPS.replace("gaps AS (SELECT method", "rgaps AS (SELECT regime, method").replace("USING (unit)", "USING (unit, regime)")


@query("i5_regime_gaps", sql(*DRAWN, SUB, RGAPS, f"SELECT regime, method, metric, {_GAPS6} FROM rgaps"))
def i5(spark, sf):
    a = Audit(spark, sf)
    return fi.mean_gaps(a.scores, a.subset(), ["regime", *fi.KEY]).select(*_gap_cols(["regime", *fi.KEY]))


BREAK = [*DRAWN, SUB, RGAPS, ks_sql("regime, method, metric"), TOL, """
br AS (SELECT regime, method, metric, n_pop, n_subset, round(abs(subset_mean - pop_mean), 9) AS abs_gap, CASE WHEN n_a >= 2 AND n_b >= 2 THEN ks END AS ks,
              coalesce(round(abs(subset_mean - pop_mean), 9) <= tau AND CASE WHEN n_a >= 2 AND n_b >= 2 THEN ks END <= tau_ks, false) AS within,
              round(round(abs(subset_mean - pop_mean), 9) / tau, 9) AS discrepancy
       FROM rgaps JOIN ks USING (regime, method, metric) JOIN tol USING (method, metric))"""]


def _breakdown(a: Audit) -> DataFrame:
    return fi.regime_breakdown(a.scores, a.subset(), a.tol())


@query("i6_regime_breakdown", sql(*BREAK, "SELECT * FROM br"))
def i6(spark, sf):
    return _breakdown(Audit(spark, sf))


@query("i7_regime_summary", sql(*BREAK, "SELECT method, metric, round(avg(abs_gap), 6) AS mean_abs_gap, count(*) FILTER (within) AS n_within, count(*) AS n_regimes, max_by(regime, (abs_gap, regime)) AS worst_regime FROM br GROUP BY ALL"))
def i7(spark, sf):
    return fi.regime_summary(_breakdown(Audit(spark, sf)))


@query("i8_check_thresholds", sql(*BREAK, GAPS, "SELECT method, metric, coalesce(round(abs(subset_mean - pop_mean), 9) <= tau, false) AS global_ok, coalesce(worst <= 2 * tau, false) AS regime_ok FROM tol JOIN gaps USING (method, metric) JOIN (SELECT method, metric, max(abs_gap) AS worst FROM br GROUP BY ALL) USING (method, metric)"))
def i8(spark, sf):
    a = Audit(spark, sf)
    return fi.check_thresholds(fi.mean_gaps(a.scores, a.subset()), _breakdown(a), a.tol())


@query("i9_joint_event", sql(*TRIED, "SELECT * FROM ev"))
def i9(spark, sf):
    return Audit(spark, sf).events()


@query("i10_method_pass", sql(*TRIED, "SELECT b, method, count(*) FILTER (ok) AS n_pass, count(*) AS n_trials FROM (SELECT b, trial, method, bool_and(ok) AS ok FROM cons GROUP BY ALL) GROUP BY ALL"))
def i10(spark, sf):
    return fi.method_pass(Audit(spark, sf).cons())


@query("i11_binding_histogram", sql(*TRIED, "SELECT b, method, metric, kind, count(*) AS n_fail FROM cons WHERE NOT ok GROUP BY ALL"))
def i11(spark, sf):
    return fi.binding_histogram(Audit(spark, sf).cons())


@query("i12_regime_event", sql(*TRIED, """
rm AS (SELECT regime, method, metric, avg(value) AS pop_mean FROM scores GROUP BY ALL),
rg AS (SELECT b, trial, regime, method, metric, round(abs(avg(value) - pop_mean), 9) AS gap FROM draws d JOIN scores s USING (unit, regime) JOIN rm USING (regime, method, metric) GROUP BY b, trial, regime, method, metric, pop_mean),
rw AS (SELECT b, trial, round(max(gap / tau), 9) AS worst FROM rg JOIN tol USING (method, metric) GROUP BY ALL)""", "SELECT b, trial, c, ok AND worst <= c AS ok FROM ev JOIN rw USING (b, trial), (SELECT unnest([1.0, 2.0, 4.0])::DOUBLE AS c)"))
def i12(spark, sf):
    a = Audit(spark, sf)
    by = ["regime", *fi.KEY]
    means = a.scores.groupBy(*by).agg(F.avg("value").alias("pop_mean"))
    t = a.drawn().join(a.scores, ["unit", "regime"]).groupBy("b", "trial", *by).agg(F.avg("value").alias("mean")).join(means, by)
    t = t.withColumn("gap", F.round(F.abs(F.col("mean") - F.col("pop_mean")), 9))
    return fi.regime_event(t, a.events(), a.tol(), [1.0, 2.0, 4.0])


@query("i13_ranking_event", sql(*TRIED, """
pd AS (SELECT metric, x.method AS f, y.method AS s, x.pop_mean - y.pop_mean AS pd, greatest(tx.tau, ty.tau) AS t FROM pm x JOIN pm y USING (metric) JOIN tol tx ON tx.method = x.method AND tx.metric = metric JOIN tol ty ON ty.method = y.method AND ty.metric = metric WHERE x.method < y.method),
od AS (SELECT b, trial, metric, x.method AS f, y.method AS s, x.mean - y.mean AS od FROM trials x JOIN trials y USING (b, trial, metric) WHERE x.method < y.method),
rr AS (SELECT b, trial, bool_and(sign(round(od, 9)) = sign(round(pd, 9))) AS a, bool_and(sign(round(od, 9)) = sign(round(pd, 9)) AND round(abs(od - pd), 9) <= t) AS bb FROM od JOIN pd USING (metric, f, s) GROUP BY ALL)""", """
SELECT b, count(*) AS n_trials, round(avg(a::INT), 9) AS order_rate, round(avg(bb::INT), 9) AS gap_rate, count(*) FILTER (ok AND a) AS n_joint_order, count(*) FILTER (ok AND bb) AS n_joint_gap,
       round(avg(a::INT) FILTER (ok), 9) AS order_given_joint FROM ev JOIN rr USING (b, trial) GROUP BY b"""))
def i13(spark, sf):
    a = Audit(spark, sf)
    t = stored(a.trials(), "trials")
    return fi.ranking_rates(fi.ranking_event(t, a.scores, fi.joint_event(fi.constraints(t, a.tol())), a.tol()))


@query("i14_ks_critical", sql(BASE, f"SELECT b, b * (SELECT count(*) FROM sz) AS n, (SELECT count(*) FROM pop) AS pop, round(1.358 * sqrt((b * (SELECT count(*) FROM sz) + (SELECT count(*) FROM pop))::DOUBLE / (b * (SELECT count(*) FROM sz) * (SELECT count(*) FROM pop))), 9) AS critical FROM (SELECT unnest({_B}) AS b)"))
def i14(spark, sf):
    n = Audit(spark, sf).pop.agg(F.count(F.lit(1)).alias("pop"), F.count_distinct("regime").alias("k"))
    d = n.select(F.explode(F.array(*[F.lit(b) for b in BUDGETS])).alias("b"), "pop", "k").withColumn("n", F.col("b") * F.col("k"))
    return d.select("b", "n", "pop", F.round(ks_critical(F.col("n"), F.col("pop")), 9).alias("critical"))


@query("i15_dispersion_tolerances", sql(BASE, TOL, "SELECT * FROM tol"))
def i15(spark, sf):
    return Audit(spark, sf).tol()


@query("i16_calibration", sql(BASE, TOL, "sg AS (SELECT method, metric, stddev_samp(value) AS sigma, avg(value) AS mean FROM scores GROUP BY ALL)", "gp AS (SELECT metric, min(round(abs(x.mean - y.mean), 9)) AS smallest_gap FROM sg x JOIN sg y USING (metric) WHERE x.method < y.method GROUP BY metric)", "SELECT metric, round(max(tau / sigma), 6) AS tau_over_sigma, any_value(smallest_gap) AS smallest_gap, max(tau) < any_value(smallest_gap) AS below_gap FROM sg JOIN tol USING (method, metric) JOIN gp USING (metric) GROUP BY metric"))
def i16(spark, sf):
    a = Audit(spark, sf)
    return fi.calibration(a.scores, a.tol())


@query("i17_random_baseline", sql(*DRAWN, SUB, GAPS, TRIAL, trials_sql(), "t AS (SELECT b, method, metric, round(mean - trials.pop_mean, 9) AS signed, round(gaps.subset_mean - gaps.pop_mean, 9) AS observed FROM trials JOIN gaps USING (method, metric))", """
SELECT b, method, metric, observed, round(avg(signed), 6) AS mean, round(stddev_samp(signed), 6) AS sd, round(quantile_cont(signed, 0.025), 6) AS q025, round(quantile_cont(signed, 0.975), 6) AS q975,
       round(100 * avg((signed <= observed)::INT), 6) AS percentile, round(avg((abs(signed) >= abs(observed))::INT), 6) AS p_two_sided FROM t GROUP BY ALL"""))
def i17(spark, sf):
    a = Audit(spark, sf)
    return fi.random_baseline(a.trials(), fi.mean_gaps(a.scores, a.subset()))


RANDOM = 1000  # subsets that an observed one is held against


@query("i18_random_percentile", sql(*DRAWN, SUB, GAPS, TRIAL, *UNIFORM[:2], draws_sql("ualloc", "udraws", "one", RANDOM, SEED + 10000), trials_sql("udraws"), "SELECT b, round(100 * avg(share), 6) AS percentile FROM (SELECT b, method, metric, avg((gap < round(abs(subset_mean - gaps.pop_mean), 9))::INT) AS share FROM trials JOIN gaps USING (method, metric) GROUP BY ALL) GROUP BY b"))
def i18(spark, sf):
    a = Audit(spark, sf)
    t = fi.trial_stats(sa.draw_uniform(a.pop, BUDGETS, RANDOM, SEED), a.scores)
    return fi.random_percentile(t, fi.mean_gaps(a.scores, a.subset()))


@query("i19_audit_subset", sql(*DRAWN, "sub AS (SELECT b, trial, unit, regime FROM draws WHERE b = 8 AND trial = 1)", TRIAL, trials_sql("sub"), TOL, cons_sql(), """
SELECT (SELECT count(*) FROM sub) AS n_asked, (SELECT count(*) FROM sub) AS n_found, (count(*) FILTER (NOT ok))::INT AS n_violated,
       coalesce(string_agg(method || ':' || metric || ':' || kind, ',' ORDER BY method || ':' || metric || ':' || kind) FILTER (NOT ok), '') AS violated, bool_and(ok) AS ok FROM cons"""))
def i19(spark, sf):
    a = Audit(spark, sf)
    return fi.audit_subset(a.scores, a.drawn().filter("b = 8 and trial = 1"), a.tol())


# ---- J


@query("j1_wilson_lcb", "SELECT p_type AS regime, count(*) AS n, count(*) FILTER (p_size > 25) AS k, round(" + WILSON.format(k="count(*) FILTER (p_size > 25)", n="count(*)") + ", 12) AS lcb FROM part GROUP BY p_type")
def j1(spark, sf):
    d = load(spark, sf, "part").groupBy(F.col("p_type").alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("k"))
    return d.withColumn("lcb", F.round(wilson_lcb(F.col("k"), F.col("n")), 12))


@query("j2_frontier", sql(*FRONT, "SELECT * FROM fr"))
def j2(spark, sf):
    return re_.frontier(Audit(spark, sf).events())


_S = "[" + ", ".join(map(str, SWEEP)) + "]"


@query("j2_full_sweep", sql(BASE, EQUAL.replace(_B, _S), draws_sql("alloc"), *FRONT[3:], "SELECT * FROM fr"))
def j2_sweep(spark, sf):
    """Eight budgets, as many trials each."""
    a = Audit(spark, sf)
    trials = fi.trial_stats(sa.draw_balanced(a.pop, SWEEP, TRIALS, SEED), a.scores)
    return re_.frontier(fi.joint_event(fi.constraints(trials, a.tol())))


@query("j2_best_draw", sql(*FRONT, "SELECT t.b, best_trial, method, metric, gap, ks FROM trials t JOIN fr ON fr.b = t.b AND fr.best_trial = t.trial"))
def j2_best(spark, sf):
    """Gaps and KS distances of each budget's best draw."""
    a = Audit(spark, sf)
    trials = stored(a.trials(), "trials")
    return re_.best_draw_stats(re_.frontier(fi.joint_event(fi.constraints(trials, a.tol()))), trials)


@query("j3_recommend", sql(*FRONT, f"SELECT target, min(b) FILTER (lcb >= target) AS b, CASE WHEN min(b) FILTER (lcb >= target) IS NULL THEN 'not reached' ELSE 'reached' END AS status FROM fr, (SELECT unnest({TARGETS})::DOUBLE AS target) GROUP BY target"))
def j3(spark, sf):
    return re_.recommend(re_.frontier(Audit(spark, sf).events()), TARGETS)


@query("j4_best_subset", worked_out_once(sql(*FRONT, "SELECT d.* FROM draws d JOIN fr ON d.b = fr.b AND d.trial = fr.best_trial"), "scores", "draws", "trials", "cons", "ev"))
def j4(spark, sf):
    a = Audit(spark, sf)
    draws = stored(a.drawn(), "draws")
    return re_.best_subset(fi.joint_event(fi.constraints(fi.trial_stats(draws, a.scores), a.tol())), draws)


SUMMARY = "sm AS (SELECT b, b * (SELECT count(*) FROM sz) AS size, lcb, true AS feasible, b <> 4 AS has_manifest FROM fr)"


def _summary(a: Audit) -> DataFrame:
    k = a.pop.agg(F.count_distinct("regime").alias("k"))
    return re_.frontier(a.events()).crossJoin(k).select("b", (F.col("b") * F.col("k")).alias("size"), "lcb", F.lit(True).alias("feasible"), (F.col("b") != 4).alias("has_manifest"))


@query("j5_select_budget", sql(*FRONT, SUMMARY, "SELECT b, size, lcb, lcb >= 0.2 AS meets, false AS no_manifest, min(size) OVER () > 60 AS no_size FROM sm WHERE has_manifest AND (size <= 60 OR (SELECT min(size) FROM sm WHERE has_manifest) > 60) ORDER BY lcb >= 0.2 DESC, CASE WHEN lcb >= 0.2 THEN size END, lcb DESC, size LIMIT 1"))
def j5(spark, sf):
    return re_.select_budget(_summary(Audit(spark, sf)), 0.2, 60)


@query("j7_pareto", sql(*FRONT, SUMMARY, "SELECT b, size, lcb FROM sm x WHERE NOT EXISTS (SELECT 1 FROM sm y WHERE y.lcb >= x.lcb AND y.size <= x.size AND (y.lcb > x.lcb OR y.size < x.size))"))
def j7(spark, sf):
    return re_.pareto(_summary(Audit(spark, sf)).select("b", "size", "lcb"), "lcb", "size")


@query("j8_sweep_targets", sql(*FRONT, SUMMARY, f"tg AS (SELECT *, unnest({TARGETS})::DOUBLE AS target FROM sm)", "SELECT target, b, size, lcb, lcb >= target AS meets FROM tg QUALIFY row_number() OVER (PARTITION BY target ORDER BY lcb >= target DESC, CASE WHEN lcb >= target THEN size END, lcb DESC, size) = 1"))
def j8(spark, sf):
    return re_.sweep_targets(_summary(Audit(spark, sf)), TARGETS)


def sets_sql(sets: dict) -> str:
    rows = ", ".join(f"('{k}', {m}, {s})" for k, (m, s) in sets.items())
    return f"""
st AS (SELECT * FROM (VALUES {rows}) AS v(name, fm, fs)),
se AS (SELECT name, b, trial, bool_and(round(ratio, 9) <= CASE WHEN kind = 'mean' THEN fm ELSE fs END) AS ok FROM cons, st GROUP BY ALL),
ss AS (SELECT name AS set, b, count(*) AS n_trials, count(*) FILTER (ok) AS n_pass, round({WILSON.format(k="count(*) FILTER (ok)", n="count(*)")}, 9) AS lcb FROM se GROUP BY ALL)"""


@query("j9_threshold_sets", sql(*TRIED, sets_sql(SETS), "SELECT * FROM ss"))
def j9(spark, sf):
    return re_.threshold_sets(Audit(spark, sf).cons(), SETS)


GRID_SQL = [*TRIED, sets_sql({f"{m}|{s}": (m, s) for m in MEANS for s in KSS}), "gd AS (SELECT split_part(set, '|', 1)::DOUBLE AS mean_factor, split_part(set, '|', 2)::DOUBLE AS ks_factor, min(b) FILTER (lcb >= 0.2) AS b FROM ss GROUP BY ALL)"]


@query("j10_tolerance_grid", sql(*GRID_SQL, "SELECT * FROM gd"))
def j10(spark, sf):
    return re_.tolerance_grid(Audit(spark, sf).cons(), MEANS, KSS, 0.2)


SEEDS = [7, 107, 207]
_SEEDED = [part for s in SEEDS for part in (draws_sql("alloc", f"d{s}", seed=s), trials_sql(f"d{s}", f"t{s}"), cons_sql(f"t{s}", f"c{s}"), events_sql(f"c{s}", f"e{s}"))]
SEEDED = [BASE, EQUAL, TRIAL, TOL, *_SEEDED, "ae AS (" + " UNION ALL ".join(f"SELECT {s} AS seed, * FROM e{s}" for s in SEEDS) + ")", frontier_sql("ae", "sf", "seed")]


def with_seeds(alloc: DataFrame) -> DataFrame:
    return alloc.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))


@query("j13_subset_overlap", sql(*SEEDED, "bs AS (" + " UNION ALL ".join(f"SELECT {s} AS seed, unit FROM d{s} JOIN sf ON sf.seed = {s} AND sf.b = 16 AND d{s}.b = 16 AND d{s}.trial = sf.best_trial" for s in SEEDS) + ")", "pr AS (SELECT x.seed AS a, y.seed AS c, (SELECT count(*) FROM bs u JOIN bs v USING (unit) WHERE u.seed = x.seed AND v.seed = y.seed) AS k, x.n AS nx, y.n AS ny FROM (SELECT seed, count(*) AS n FROM bs GROUP BY 1) x, (SELECT seed, count(*) AS n FROM bs GROUP BY 1) y WHERE x.seed < y.seed)", "SELECT count(*) AS n_pairs, round(avg(k::DOUBLE / (nx + ny - k)), 9) AS mean_jaccard, round(avg(k::DOUBLE / least(nx, ny)), 9) AS mean_overlap FROM pr"))
def j13(spark, sf):
    a, keys = Audit(spark, sf), ["seed", *fi.TRIAL]
    draws = stored(sa.draw_allocated(a.pop, with_seeds(sa.allocate_equal(a.pop, BUDGETS)), TRIALS, "seed"), "draws")
    events = fi.joint_event(fi.constraints(fi.trial_stats(draws, a.scores, keys=keys), a.tol(), keys), keys)
    best = re_.frontier(events, ["seed"]).filter("b = 16").select("seed", "b", F.col("best_trial").alias("trial"))
    return re_.subset_overlap(draws.join(best, ["seed", "b", "trial"], "left_semi").select("seed", "unit"), "seed")


MODES = [*TRIED, *UNIFORM, trials_sql("udraws", "ut"), cons_sql("ut", "uc"), PROPORTIONAL, draws_sql("prop", "pdraws"), trials_sql("pdraws", "pt"), cons_sql("pt", "pc")]
ALL_CONS = "ac AS (SELECT 'equal' AS generator, * FROM cons UNION ALL SELECT 'uniform', * FROM uc UNION ALL SELECT 'proportional', * FROM pc)"


GENERATOR = ["generator", *fi.TRIAL]


def _generators(a: Audit) -> tuple[DataFrame, DataFrame]:
    """Trials and constraints of three generators, drawn at once."""
    k = a.pop.select("regime").distinct().count()
    named = lambda df, name, seed=None: df.withColumn("generator", F.lit(name)) if seed is None else df.withColumns({"generator": F.lit(name), "seed": F.lit(seed)})
    all_ = a.pop.select("unit", F.lit("all").alias("regime"))
    pops = union_all([named(a.pop, "equal"), named(a.pop, "proportional"), named(all_, "uniform")])
    uniform = a.pop.sparkSession.createDataFrame([(b, "all", k * b) for b in BUDGETS], "b int, regime string, take int")
    allocs = union_all([named(sa.allocate_equal(a.pop, BUDGETS), "equal", SEED), named(sa.allocate_proportional(a.pop, BUDGETS), "proportional", SEED), named(uniform, "uniform", SEED + 10000)])
    trials = stored(fi.trial_stats(sa.draw_allocated(pops, allocs, TRIALS, "seed", ["generator"]), a.scores, keys=GENERATOR), "trials")
    return trials, fi.constraints(trials, a.tol(), GENERATOR)


ALL_EVENTS = f"ae AS (SELECT generator, b, trial, {EVENT} FROM ac GROUP BY ALL)"
ALLOC_FRONT = [*MODES, ALL_CONS, ALL_EVENTS, frontier_sql("ae", "af", "generator")]


@query("j14_failure_modes", sql(*ALLOC_FRONT, "fm AS (SELECT generator, b, trial, bool_and(ok) FILTER (kind = 'mean') AS means, bool_and(ok) FILTER (kind = 'ks') AS kss, bool_and(ok) AS ok, round(max(ratio) FILTER (kind = 'mean'), 9) AS objective FROM ac WHERE generator <> 'proportional' GROUP BY ALL)",
        "SELECT generator, b, count(*) AS n_trials, count(*) FILTER (means) AS n_means, count(*) FILTER (kss) AS n_ks, count(*) FILTER (ok) AS n_joint, count(*) FILTER (means AND NOT ok) AS n_means_only, min_by(trial, [objective, trial::DOUBLE]) FILTER (means AND NOT ok) AS example, "
        f"round({WILSON.format(k='count(*) FILTER (ok)', n='count(*)')}, 9) AS lcb, round(count(*) FILTER (ok)::DOUBLE / count(*), 9) AS rate, '' AS note FROM fm GROUP BY generator, b UNION ALL SELECT generator, b, NULL, NULL, NULL, NULL, NULL, NULL, lcb, rate, 'summary only' FROM af WHERE generator = 'proportional'"))  # fmt: skip
def j14(spark, sf):
    """Two generators by trials; of the third only the summary is taken as known."""
    _, cons = _generators(Audit(spark, sf))
    summary = re_.frontier(fi.joint_event(cons.filter("generator = 'proportional'"), GENERATOR), ["generator"])
    return re_.with_summaries(re_.failure_modes(cons.filter("generator <> 'proportional'"), ["generator"]), summary)


@query("j14_exported_draws", sql(*MODES, ALL_CONS, ALL_EVENTS, "atr AS (SELECT 'equal' AS generator, * FROM trials UNION ALL SELECT 'uniform', * FROM ut UNION ALL SELECT 'proportional', * FROM pt)", """
pd AS (SELECT metric, x.method AS f, y.method AS s, x.pop_mean - y.pop_mean AS pd FROM pm x JOIN pm y USING (metric) WHERE x.method < y.method),
od AS (SELECT generator, b, trial, metric, x.method AS f, y.method AS s, x.mean - y.mean AS od FROM atr x JOIN atr y USING (generator, b, trial, metric) WHERE x.method < y.method),
ko AS (SELECT generator, b, trial, bool_and(sign(round(od, 9)) = sign(round(pd, 9))) AS keeps_order FROM od JOIN pd USING (metric, f, s) GROUP BY ALL),
eo AS (SELECT * FROM ae JOIN ko USING (generator, b, trial))""", " UNION ALL ".join(
    f"SELECT * FROM (SELECT generator, b, '{c}' AS criterion, trial, mean_objective, joint_objective, max_ks, keeps_order FROM eo QUALIFY row_number() OVER (PARTITION BY generator, b ORDER BY {c}_objective, {o}_objective, trial) = 1)" for c, o in (("joint", "mean"), ("mean", "joint")))))
def j14_exported(spark, sf):
    """What a joint and a mean-only criterion export, and whether the ranking of methods is kept."""
    a = Audit(spark, sf)
    trials, cons = _generators(a)
    events = fi.ranking_event(trials, a.scores, fi.joint_event(cons, GENERATOR), a.tol(), GENERATOR)
    return re_.exported_draws(events, ["generator"], {"joint": ("joint_objective", "mean_objective"), "mean": ("mean_objective", "joint_objective")})


def _alloc_front(a: Audit) -> DataFrame:
    return re_.frontier(fi.joint_event(_generators(a)[1], GENERATOR), ["generator"])


@query("j15_compare_allocations", sql(*ALLOC_FRONT, "SELECT * FROM af"))
def j15(spark, sf):
    return _alloc_front(Audit(spark, sf))


@query("j16_baseline_min_size", sql(*ALLOC_FRONT, "SELECT list_position(['uniform', 'proportional', 'equal'], generator) AS place, generator, coalesce((min(b) FILTER (lcb >= 0.2))::VARCHAR, '>' || max(b)::VARCHAR) AS size FROM af GROUP BY generator"))
def j16(spark, sf):
    return re_.baseline_min_size(_alloc_front(Audit(spark, sf)), 0.2, ["uniform", "proportional", "equal"])


@query("j18_ks_knee", sql(*GRID_SQL, "SELECT ks_factor, min(b) AS b, min(b) IS NOT NULL AS feasible FROM gd WHERE mean_factor = 2.0 GROUP BY ks_factor"))
def j18(spark, sf):
    return re_.knee(re_.tolerance_grid(Audit(spark, sf).cons(), MEANS, KSS, 0.2).filter("mean_factor = 2.0"))


LEVELS = {"two": ["N", "R"], "three": ["A", "N", "R"]}


@query("j19_multi_method_frontier", sql(*TRIED, "lv AS (SELECT 'two' AS level, * FROM cons WHERE method IN ('N', 'R') UNION ALL SELECT 'three', * FROM cons)", f"le AS (SELECT level, b, trial, {EVENT} FROM lv GROUP BY ALL)", frontier_sql("le", "lf", "level"), "SELECT * FROM lf"))
def j19(spark, sf):
    cons = stored(Audit(spark, sf).cons(), "constraints")
    return re_.frontier(union_all([fi.joint_event(cons.filter(F.col("method").isin(m))).withColumn("level", F.lit(k)) for k, m in LEVELS.items()]), ["level"])
