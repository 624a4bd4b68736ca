"""Queries for regimes, optimisation, and audits over several regime counts and splits (F, L, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import union_all
from ..operators import fidelity as fi
from ..operators import optimize as op
from ..operators import regimes as rg
from ..operators import reliability as re_
from ..operators import sampling as sa
from ..sources import files as fs
from ..sources.tables import load, scratch, stored
from . import audit
from .audit import BASE, BUDGETS, DRAWN, EQUAL, FRONT, SEED, SUB, TRIALS, Audit, draws_sql, sql
from .profiles import FEATURES, descriptors, rounded

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


def vectors(spark, sf) -> DataFrame:
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("unit"), "label", F.col("embedding").cast("array<double>").alias("v"))


V = "v AS (SELECT vec_id AS unit, label, embedding::DOUBLE[] AS v FROM embeddings)"
X = "x AS (SELECT unit, label, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM v)"


def parts(spark, sf) -> DataFrame:
    return stored(rg.scaled(stored(descriptors(spark, sf), "descriptors"), FEATURES), "scaled")


@query("f1_cluster_regimes")
def f1(spark, sf):
    return rg.cluster_regimes(parts(spark, sf), 6, 42).select("unit", "cluster")


@query("f2_silhouette", f"""WITH {V}, {X}, mv AS (SELECT label AS other, i, avg(x) AS m FROM x GROUP BY ALL), sq AS (SELECT unit, label, sum(x * x) AS s FROM x GROUP BY ALL), cl AS (SELECT label AS other, count(*) AS n, avg(s) AS ms FROM sq GROUP BY label),
dt AS (SELECT unit, other, sum(x * m) AS dot FROM x JOIN mv USING (i) GROUP BY ALL), d AS (SELECT unit, label, other, n, s + ms - 2 * dot AS d FROM dt JOIN sq USING (unit) JOIN cl USING (other)),
ab AS (SELECT unit, max(d * n / (n - 1)) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM d GROUP BY unit) SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab""")
def f2(spark, sf):
    return rg.silhouette(vectors(spark, sf))


@query("f2_silhouette_exact", f"WITH {V}, p AS (SELECT a.unit, a.label AS la, b.label AS lb, avg(list_distance(a.v, b.v)) AS d FROM v a JOIN v b ON a.unit <> b.unit GROUP BY ALL), ab AS (SELECT unit, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM p GROUP BY unit) SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab")
def f2_exact(spark, sf):
    return rg.silhouette_exact(vectors(spark, sf))


@query("f3_choose_k")
def f3(spark, sf):
    return rg.choose_k(parts(spark, sf), [3, 4, 5, 6], 42)


@query("f4_cluster_balance", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT n, n::DOUBLE / sum(n) OVER () AS p FROM c) SELECT count(*) AS k, round(min(n)::DOUBLE / max(n), 9) AS balance, round(-sum(p * ln(p)) / ln(greatest(2, count(*))), 9) AS entropy FROM p")
def f4(spark, sf):
    return rg.cluster_balance(vectors(spark, sf), "label")


CRITERIA = "cr AS (SELECT label AS k, count(*)::DOUBLE AS size, NULL::DOUBLE AS none, round(avg(embedding[1]), 6) AS compact FROM embeddings GROUP BY label)"


@query("f5_score_k", f"WITH {CRITERIA}, s AS (SELECT *, round((2 * (size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()) + 0 + 1 - (compact - min(compact) OVER ()) / (max(compact) OVER () - min(compact) OVER ())) / 4.0::DOUBLE, 9) AS score FROM cr) SELECT *, row_number() OVER (ORDER BY score DESC, k) AS rank, CASE WHEN k <= 5 THEN row_number() OVER (PARTITION BY k <= 5 ORDER BY score DESC, k) END AS rank_within FROM s")
def f5(spark, sf):
    d = load(spark, sf, "embeddings").groupBy(F.col("label").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("size"), F.lit(None).cast("double").alias("none"), F.round(F.avg(F.col("embedding")[0]), 6).alias("compact"))
    return rg.score_k(d, {"size": 2.0, "none": 1.0, "compact": 1.0, "unused": 0.0}, {"compact"}, 5)


REPS = f"{V}, {X}, mc AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), dd AS (SELECT label, unit, round(sqrt(sum((x - m) * (x - m))), 9) AS d FROM x JOIN mc USING (label, i) GROUP BY ALL), rp AS (SELECT label, unit, row_number() OVER (PARTITION BY label ORDER BY d, unit) AS rank FROM dd QUALIFY rank <= 3)"


@query("f6_reps_centroid", f"WITH {REPS} SELECT * FROM rp")
def f6(spark, sf):
    return rg.reps_centroid(vectors(spark, sf), 3)


@query("f7_reps_medoid", f"WITH {V}, s AS (SELECT a.label, a.unit, round(sum(list_distance(a.v, b.v)), 6) AS total FROM v a JOIN v b USING (label) GROUP BY ALL) SELECT label, unit, total FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY total, unit) = 1")
def f7(spark, sf):
    return rg.reps_medoid(vectors(spark, sf))


@query("f8_rep_metric_summary", sql(BASE, REPS, "SELECT method, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM scores WHERE unit IN (SELECT unit FROM rp) GROUP BY ALL"))
def f8(spark, sf):
    return rounded(rg.rep_metric_summary(rg.reps_centroid(vectors(spark, sf), 3), audit.scores(spark, sf)), [])


GROUPS = {"price": ["price_avg", "price_sd", "retail"], "quantity": ["qty_max", "qty_min"], "discount": ["disc_avg"], "part": ["size"]}


@query("f9_group_ablation")
def f9(spark, sf):
    """Each feature group alone, and all without it: cluster anew, then the frontier over these regimes."""
    desc, s = stored(descriptors(spark, sf), "descriptors"), audit.scores(spark, sf)
    named, rest = [c for g in GROUPS.values() for c in g], [c for c in FEATURES if c not in [c for g in GROUPS.values() for c in g]]
    out = []
    for name, cols in (GROUPS | ({"other": rest} if rest else {})).items():
        for kind, used in (("alone", cols), ("left_out", [c for c in named + rest if c not in cols])):
            new = rg.cluster_regimes(rg.scaled(desc, used), 4, 42)
            out.append(new.select(F.lit(f"{name}|{kind}").alias("grouping"), "unit", F.col("cluster").cast("string").alias("regime")))
    front = fronts(s, stored(union_all(out), "groupings"))
    return front.select(F.split("grouping", r"\|")[0].alias("feature_group"), F.split("grouping", r"\|")[1].alias("kind"), *[c for c in front.columns if c != "grouping"])


def fronts(s: DataFrame, groupings: DataFrame, sizes: list[int] | None = None, seeds: bool = False) -> DataFrame:
    """grouping (and seed), b, size and the frontier over the regimes of each grouping (grouping, unit, regime), drawn at once.

    sizes: total sizes, from which each grouping gets its own budgets; else BUDGETS. Draws of a grouping are its own.
    """
    pop = stored(groupings.join(s.select("unit").distinct(), "unit", "left_semi"), "population")
    by = ["grouping"]
    alloc = sa.allocate_equal(pop, BUDGETS, by) if sizes is None else sa.allocate_by_size(pop, sizes, by)
    alloc = audit.with_seeds(alloc) if seeds else alloc
    keys = [*by, *(["seed"] if seeds else []), *fi.TRIAL]
    draws = sa.draw_allocated(pop, alloc, TRIALS, "seed" if seeds else SEED, by)
    events = fi.joint_event(fi.constraints(fi.trial_stats(draws, s, keys=keys), fi.tolerances(s, audit.TAU_C, audit.TAU_KS), keys), keys)
    k = pop.groupBy("grouping").agg(F.count_distinct("regime").alias("k"))
    front = re_.frontier(events, keys[:-2]).join(k, "grouping").withColumn("size", F.col("b") * F.col("k"))
    return front.select(*keys[:-2], "k", "b", "size", *[c for c in front.columns if c not in (*keys, "k", "size")])


@query("f10_adjusted_rand", "WITH c AS (SELECT label % 7 AS a, label % 5 AS b, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS i, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS j) SELECT round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 9) AS ari FROM t")
def f10(spark, sf):
    return rg.adjusted_rand(vectors(spark, sf).select((F.col("label") % 7).alias("a"), (F.col("label") % 5).alias("b")), "a", "b")


@query("f11_project_2d")
def f11(spark, sf):
    return rg.project_2d(vectors(spark, sf))


@query("f12_radius_components", f"WITH RECURSIVE {V}, p AS (SELECT unit, v[1] AS x, v[2] AS y FROM v), e AS (SELECT a.unit AS a, b.unit AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0004), r AS (SELECT unit, unit AS root FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.unit) SELECT unit, min(root) AS root FROM r GROUP BY unit")
def f12(spark, sf):
    d = vectors(spark, sf)
    return rg.radius_components(d.select("unit", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), 0.02)


@query("f13_region_bounds", f"WITH {V}, p AS (SELECT v[1] AS x, v[2] AS y, label = 3 AS f FROM v), b AS (SELECT min(x) FILTER (f) AS a, max(x) FILTER (f) AS b, min(y) FILTER (f) AS c, max(y) FILTER (f) AS d FROM p) SELECT round(a - 0.2 * (b - a), 6) AS x_low, round(b + 0.2 * (b - a), 6) AS x_high, round(c - 0.2 * (d - c), 6) AS y_low, round(d + 0.2 * (d - c), 6) AS y_high FROM b")
def f13(spark, sf):
    d = vectors(spark, sf).select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), (F.col("label") == 3).alias("f"))
    return rounded(rg.region_bounds(d, "f"), [])


@query("f14_hull")
def f14(spark, sf):
    return rg.hull(vectors(spark, sf).select("label", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), "label")


# ---- L


@query("l1_refine_swap")
def l1(spark, sf):
    """Objective before and after each swap, from the best of a drawn subset and four restarts."""
    a = Audit(spark, sf)
    wide = a.pop.join(audit.wide_r(a, spark, sf).drop("runtime"), "unit")
    _, trace = op.refine_restarts(wide, a.subset(), {"price": 2.0, "qty": 2.5}, 6)
    return spark.createDataFrame([(i, round(x, 9)) for i, x in enumerate(trace)], "swaps int, objective double")


@query("l2_facility_location")
def l2(spark, sf):
    """Subsets of 12 units from pools of 16, 400 runs."""
    return op.facility_location(vectors(spark, sf).drop("label"), 12, 16, 400)


@query("l3_regime_coverage", sql(*DRAWN, SUB, "SELECT regime, count(*) AS total, count(s.unit) AS selected, round(100.0::DOUBLE * count(s.unit) / count(*), 6) AS pct, count(s.unit) < 3 AS thin FROM pop LEFT JOIN (SELECT unit FROM sub WHERE regime <> (SELECT min(regime) FROM pop)) s USING (unit) GROUP BY regime"))
def l3(spark, sf):
    a = Audit(spark, sf)
    first = a.pop.agg(F.min("regime").alias("r"))
    return op.regime_coverage(a.pop, a.subset().crossJoin(first).filter("regime <> r"))


@query("l4_selector_stability")
def l4(spark, sf):
    """Facility-location runs with different seeds: how many pass the joint event on two components as metrics, and how much they overlap."""
    v = vectors(spark, sf).drop("label")
    values = F.explode(F.array(*[F.struct(F.lit(f"v{i}").alias("metric"), F.col("v")[i].alias("value")) for i in range(2)]))
    s = stored(v.select("unit", F.lit("vector").alias("method"), values.alias("x")).select("unit", "method", "x.*"), "scores")
    return re_.selector_stability(op.facility_location(v, 36, 16, 20), s, fi.tolerances(s, 0.5, 0.3))


# ---- J over several regime counts and splits

REGIMES = {1: "p_type", 2: "substr(p_brand, 7, 1)", 3: "substr(p_brand, 8, 1)"}  # groupings of the parts; the same in Spark and in SQL
SIZES = [12, 24, 48, 96]
_Z = str(SIZES)
BY_SIZE = f"""ks AS (SELECT count(*) AS k, min(n) AS smallest FROM sz), equal AS (SELECT DISTINCT floor(size::DOUBLE / k + 0.5)::INT AS b, smallest FROM (SELECT unnest({_Z}) AS size), ks),
alloc AS (SELECT b, regime, b AS take FROM equal, sz WHERE b >= 1 AND b <= smallest)"""


def base_sql(regime: str, where: str = "true") -> str:
    return BASE.replace("p_type AS regime", f"{regime} AS regime").replace("scores AS (SELECT * FROM raw WHERE", f"scores AS (SELECT * FROM raw WHERE {where} AND")


def front_sql(regime: str, budgets: str = EQUAL, seed: int = SEED) -> str:
    parts = [base_sql(regime), budgets, draws_sql("alloc", seed=seed), *FRONT[3:]]
    return "(" + sql(*parts, "SELECT (SELECT count(*) FROM sz) AS k, b, b * (SELECT count(*) FROM sz) AS size, fr.* EXCLUDE (b) FROM fr") + ")"


def groupings(spark, sf) -> DataFrame:
    p = load(spark, sf, "part")
    return union_all([p.select(F.lit(k).alias("grouping"), F.col("p_partkey").alias("unit"), F.expr(e).alias("regime")) for k, e in REGIMES.items()])


BY_K = " UNION ALL ".join(f"SELECT {k} AS grouping, * FROM {front_sql(e, BY_SIZE)}" for k, e in REGIMES.items())
ARI = "ari AS (" + " UNION ALL ".join(
    f"SELECT {k} AS grouping, CASE WHEN (i + j) / 2 - i * j / (n * (n - 1) / 2) = 0 THEN 1 ELSE round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 9) END AS ari FROM (SELECT (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM pt GROUP BY p_type, {e})) AS ij, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM pt GROUP BY p_type)) AS i, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM pt GROUP BY {e})) AS j, (SELECT count(*) FROM pt) AS n)"
    for k, e in REGIMES.items()) + ")"


def with_recommendation(front: DataFrame, target: float = 0.2, by: list[str] = ("grouping",)) -> DataFrame:
    """front with `recommended`, the first size of its grouping whose bound meets the target; null where none does."""
    first = F.min(F.when(F.col("lcb") >= target, F.col("size"))).over(Window.partitionBy(*by))
    return front.withColumn("recommended", first)


@query("j12_regime_count_grid", f"WITH {BASE}, pt AS (SELECT * FROM part WHERE p_partkey IN (SELECT unit FROM scores)), {ARI} SELECT f.*, ari, min(CASE WHEN lcb >= 0.2 THEN size END) OVER (PARTITION BY grouping) AS recommended FROM ({BY_K}) f JOIN ari USING (grouping)")
def j12(spark, sf):
    """Groupings of the parts with budgets from total sizes, and their adjusted Rand index against the first."""
    s, g = audit.scores(spark, sf), groupings(spark, sf)
    front = stored(with_recommendation(fronts(s, g, SIZES)), "fronts")
    wide = g.join(s.select("unit").distinct(), "unit", "left_semi").groupBy("unit").pivot("grouping", list(REGIMES)).agg(F.first("regime"))
    ari = union_all([rg.adjusted_rand(wide, "1", str(k)).withColumn("grouping", F.lit(k)) for k in REGIMES])
    return front.join(ari, "grouping").select(*front.columns[:-1], "ari", "recommended")


KS = [4, 5, 6, 8, 10]


@query("j12_cluster_counts")
def j12_clusters(spark, sf):
    """The same over clusterings of the descriptors into k regimes; the index is against that with six."""
    s, v = audit.scores(spark, sf), parts(spark, sf)
    labels = {k: stored(rg.cluster_regimes(v, k, 42).select("unit", F.col("cluster").cast("string").alias("regime")), "clusters") for k in KS}
    front = stored(with_recommendation(fronts(s, union_all([d.withColumn("grouping", F.lit(k)) for k, d in labels.items()]), SIZES)), "fronts")
    six = labels[6].withColumnRenamed("regime", "six")
    ari = union_all([rg.adjusted_rand(d.join(six, "unit"), "regime", "six").withColumn("grouping", F.lit(k)) for k, d in labels.items()])
    return front.join(ari, "grouping").select(*front.columns[:-1], "ari", "recommended")


SEED_GRID = "gr AS (" + " UNION ALL ".join(f"SELECT {k} AS grouping, {s} AS seed, min(size) FILTER (lcb >= 0.1) AS size, max(n_pass) AS most_pass FROM {front_sql(e, seed=s)}" for k, e in REGIMES.items() for s in audit.SEEDS) + ")"


def seed_grid(spark, sf) -> DataFrame:
    front = fronts(audit.scores(spark, sf), groupings(spark, sf), seeds=True)
    return front.groupBy("grouping", "seed").agg(F.min(F.when(F.col("lcb") >= 0.1, F.col("size"))).alias("size"), F.max("n_pass").alias("most_pass"))


@query("j11_seed_grid", f"WITH {SEED_GRID} SELECT * FROM gr")
def j11(spark, sf):
    """Recommended size for each grouping and audit seed."""
    return seed_grid(spark, sf)


@query("j11_recommendations", f"WITH {SEED_GRID} SELECT coalesce(size::VARCHAR, 'not reached') AS recommended, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM gr GROUP BY size")
def j11_recommendations(spark, sf):
    """How often each size is recommended over the grid."""
    return re_.recommendations(seed_grid(spark, sf))


@query("j11_cluster_seeds")
def j11_clusters(spark, sf):
    """Recommended size for each seed of the clustering and of the audit."""
    v = parts(spark, sf)
    new = [rg.cluster_regimes(v, 6, seed).select(F.lit(seed).alias("grouping"), "unit", F.col("cluster").cast("string").alias("regime")) for seed in (0, 1, 2)]
    front = fronts(audit.scores(spark, sf), stored(union_all(new), "groupings"), seeds=True)
    return front.groupBy("grouping", "seed").agg(F.min(F.when(F.col("lcb") >= 0.1, F.col("size"))).alias("size"), F.max("n_pass").alias("most_pass"))


# ---- the joint sweep over groupings and budgets, and its holdout


def split_sql(name: str) -> str:
    """Units of one part of the stratified split."""
    return f"unit IN (SELECT unit FROM ({audit.SQL['h6_stratified_split']}) WHERE split = '{name}')"


def sweep_sql(regime: str, where: str = "true") -> str:
    """k, b, size, feasible and the simulation's summary; budgets that a regime can't fill are there too."""
    parts = [base_sql(regime, where), EQUAL, draws_sql("alloc"), audit.RUNTIME, audit.WIDE, audit.sim_sql(), *audit.summary_sql()]
    return "(" + sql(*parts, f"SELECT k, f.b, f.b * k AS size, f.b <= smallest AS feasible, coalesce(rate, 0) AS rate, coalesce(lcb, 0) AS lcb, best_objective, coalesce(best_pass, false) AS best_pass, coalesce(best_regime_pass, false) AS best_regime_pass, best_trial FROM (SELECT unnest({BUDGETS}) AS b, k, smallest FROM (SELECT count(*) AS k, min(n) AS smallest FROM sz)) f LEFT JOIN su USING (b)") + ")"


SHAPE = "(SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM (SELECT unit, max(d * n / (n - 1)) FILTER (label = other AND n > 1) AS a, min(d) FILTER (label <> other) AS b FROM (SELECT unit, label, other, n, x * x + y * y + ms - 2 * (x * mx + y * my) AS d FROM vv{k}, (SELECT label AS other, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS ms FROM vv{k} GROUP BY label)) GROUP BY unit)) AS silhouette, (SELECT round(min(n)::DOUBLE / max(n), 9) FROM (SELECT count(*) AS n FROM vv{k} GROUP BY label)) AS balance"
SHAPES = f"shp AS (WITH {BASE}, " + ", ".join(f"vv{k} AS (SELECT p_partkey AS unit, {e} AS label, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part WHERE p_partkey IN (SELECT unit FROM scores))" for k, e in REGIMES.items()) + " " + " UNION ALL ".join(f"SELECT {k} AS grouping, {SHAPE.format(k=k)}" for k in REGIMES) + ")"


def swept(where: str = "true") -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS grouping, * FROM {sweep_sql(e, where)}" for k, e in REGIMES.items()) + ") JOIN shp USING (grouping)"


def chosen(table: str, target: float, size: int) -> str:
    """The rules of the joint selection."""
    return f"""(WITH f AS (SELECT *, best_pass AND best_regime_pass AS strict, lcb >= {target} AS meets FROM {table} WHERE feasible),
c AS (SELECT * FROM f WHERE CASE WHEN NOT (SELECT bool_or(strict) FROM f) THEN true WHEN (SELECT bool_or(strict AND size <= {size}) FROM f) THEN strict AND size <= {size} ELSE strict END)
SELECT * FROM c ORDER BY meets DESC, CASE WHEN meets THEN size END, lcb DESC, size, silhouette DESC NULLS LAST, balance DESC NULLS LAST, grouping, b LIMIT 1)"""


def shapes(spark, sf, s: DataFrame) -> DataFrame:
    """grouping, silhouette and balance of each grouping in the plane of size and price."""
    v = load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("v"))
    g = stored(groupings(spark, sf).join(s.select("unit").distinct(), "unit", "left_semi").join(v, "unit"), "vectors")
    one = lambda k: rg.silhouette(g.filter(F.col("grouping") == k), "regime").crossJoin(rg.cluster_balance(g.filter(F.col("grouping") == k), "regime").select("balance"))
    return union_all([one(k).select(F.lit(k).alias("grouping"), "silhouette", "balance") for k in REGIMES])


def sweep(spark, sf, units: DataFrame | None = None, only: int | None = None) -> DataFrame:
    return swept_draws(spark, sf, units, only)[0]


def swept_draws(spark, sf, units: DataFrame | None = None, only: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(grouping, k, b, size, feasible and the summary of a simulation of each grouping and budget, over some units; the draws)."""
    a = Audit(spark, sf)
    s = a.scores if units is None else stored(a.scores.join(units, "unit", "left_semi"), "scores")
    a.scores, a.pop = s, audit.population(s)
    g = groupings(spark, sf) if only is None else groupings(spark, sf).filter(F.col("grouping") == only)
    pop, by = stored(g.join(a.pop.select("unit"), "unit", "left_semi"), "population"), ["grouping"]
    draws, wide = stored(sa.draw_allocated(pop, sa.allocate_equal(pop, BUDGETS, by), TRIALS, SEED, by), "draws"), stored(audit.wide_r(a, spark, sf), "wide")
    sim = fi.simulate_budget(draws, wide, audit.SIM_TOL, 0.1, [*by, *fi.TRIAL])
    su = fi.budget_summary(sim, draws, pop, wide, audit.SIM_TOL, audit.REGIME_TOL, by).drop("size")
    frame = sa.budget_frame(pop, BUDGETS, by).groupBy(*by, "b").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"))
    d = frame.join(su, [*by, "b"], "left")
    zero, no = F.lit(0.0), F.lit(False)
    d = d.select(*by, "k", "b", (F.col("b") * F.col("k")).alias("size"), (F.col("b") <= F.col("smallest")).alias("feasible"), F.coalesce("rate", zero).alias("rate"), F.coalesce("lcb", zero).alias("lcb"),
                    "best_objective", F.coalesce("best_pass", no).alias("best_pass"), F.coalesce("best_regime_pass", no).alias("best_regime_pass"), "best_trial")
    return d, draws


@query("j6_joint_sweep", f"WITH {SHAPES}, sw AS ({swept()}), ch AS {chosen('sw', 0.2, 60)} SELECT sw.*, NOT EXISTS (SELECT 1 FROM sw y WHERE y.lcb >= sw.lcb AND y.size <= sw.size AND (y.lcb > sw.lcb OR y.size < sw.size)) AS pareto, row_number() OVER (ORDER BY sw.lcb DESC, sw.size, sw.silhouette DESC NULLS LAST, sw.grouping, sw.b) AS rank, (sw.grouping, sw.b) = (SELECT (grouping, b) FROM ch) AS recommended FROM sw")
def j6_sweep(spark, sf):
    """All groupings and budgets with Pareto rows, ranks and the recommended row."""
    d = stored(sweep(spark, sf).join(shapes(spark, sf, audit.scores(spark, sf)), "grouping"), "sweep")
    by = lambda df, a, b: df.withColumnRenamed(a, b)
    return by(by(re_.joint_sweep(by(by(d, "k", "regimes"), "grouping", "k"), 0.2, 60), "k", "grouping"), "regimes", "k")


@query("j6_select_joint", f"WITH {SHAPES}, sw AS ({swept()}) SELECT grouping, b, size, rate, lcb, silhouette, balance, meets FROM {chosen('sw', 0.2, 60)}")
def j6(spark, sf):
    d = sweep(spark, sf).join(shapes(spark, sf, audit.scores(spark, sf)), "grouping")
    return re_.select_joint(d.drop("k").withColumnRenamed("grouping", "k"), 0.2, 60).withColumnRenamed("k", "grouping")


def manifest_sql(regime: str) -> str:
    """The best draw of each budget."""
    parts = [base_sql(regime), EQUAL, draws_sql("alloc"), audit.RUNTIME, audit.WIDE, audit.sim_sql(), *audit.summary_sql()]
    return "(" + sql(*parts, "SELECT d.b, d.trial, d.unit, d.regime FROM draws d JOIN su ON d.b = su.b AND d.trial = su.best_trial") + ")"


@query("j6_exported_subset", f"WITH {SHAPES}, sw AS ({swept()}), ch AS {chosen('sw', 0.2, 60)}, mf AS (" + " UNION ALL ".join(f"SELECT {k} AS grouping, * FROM {manifest_sql(e)}" for k, e in REGIMES.items()) + ") SELECT grouping, b, trial, unit, regime FROM mf JOIN ch USING (grouping, b)")
def j6_exported(spark, sf):
    """A manifest of the best draw is written for each grouping and budget that can be drawn; read back is that of the
    recommended row."""
    summary, draws = swept_draws(spark, sf)
    summary = stored(summary.join(shapes(spark, sf, audit.scores(spark, sf)), "grouping"), "summary")
    best = summary.filter("feasible").select("grouping", "b", F.col("best_trial").alias("trial"))
    path = scratch(spark, "manifests")
    fs.write_manifests(draws.join(best, ["grouping", "b", "trial"], "left_semi").select("grouping", "b", "trial", "unit", "regime"), path, ["grouping", "b"])
    one = re_.select_joint(summary.drop("k").withColumnRenamed("grouping", "k"), 0.2, 60).select(F.col("k").alias("grouping"), "b").first()
    kept = spark.read.option("header", True).schema("trial int, unit long, regime string, grouping int, b int").csv(path)
    at = (F.col("grouping") == one["grouping"]) & (F.col("b") == one["b"]) if one else F.lit(False)
    return kept.filter(at).select("grouping", "b", "trial", "unit", "regime")


HOLDOUT = f"{SHAPES}, " + ", ".join(f"{n} AS ({swept(split_sql(n))})" for n in ("selection", "tune", "test"))


@query("j17_holdout_protocol", f"WITH {HOLDOUT}, ch AS {chosen('selection', 0.2, 60)} SELECT ch.grouping, ch.b, ch.size, ch.lcb AS selection_lcb, " + ", ".join(f"{n}.lcb AS {n}_lcb, {n}.best_pass AS {n}_pass, {n}.best_regime_pass AS {n}_regime_pass" for n in ("tune", "test")) + ", coalesce(tune.best_pass AND tune.best_regime_pass AND test.best_pass AND test.best_regime_pass, false) AS passed FROM ch LEFT JOIN tune ON tune.grouping = ch.grouping AND tune.b = ch.b LEFT JOIN test ON test.grouping = ch.grouping AND test.b = ch.b")
def j17(spark, sf):
    """Grouping and budget chosen on the selection part, re-evaluated on tune and test; passes if the best draws of both hold globally and in every regime."""
    s = audit.scores(spark, sf)
    split = stored(sa.stratified_split(audit.population(s), 0.6, 0.2, SEED), "split")
    units = {n: split.filter(F.col("split") == n).select("unit") for n in ("selection", "tune", "test")}
    d = sweep(spark, sf, units["selection"]).join(shapes(spark, sf, s), "grouping")
    best = stored(re_.select_joint(d.drop("k").withColumnRenamed("grouping", "k"), 0.2, 60), "chosen").select(F.col("k").alias("grouping"), "b", "size", F.col("lcb").alias("selection_lcb"))
    row = best.first()  # one row
    for n in ("tune", "test"):
        held = sweep(spark, sf, units[n], row["grouping"] if row else None)
        best = best.join(held.select("grouping", "b", F.col("lcb").alias(f"{n}_lcb"), F.col("best_pass").alias(f"{n}_pass"), F.col("best_regime_pass").alias(f"{n}_regime_pass")), ["grouping", "b"], "left")
    ok = F.col("tune_pass") & F.col("tune_regime_pass") & F.col("test_pass") & F.col("test_regime_pass")
    return best.withColumn("passed", F.coalesce(ok, F.lit(False)))
