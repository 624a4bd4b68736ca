"""Queries over k-means clusterings, which SQL can't say: each grouping's rows are what it has alone, and indices are right."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from subsieve.operators import fidelity as fi
from subsieve.operators import regimes as rg
from subsieve.operators import reliability as re_
from subsieve.operators import sampling as sa
from subsieve.plans import audit, clusters
from subsieve.plans.profiles import descriptors
from subsieve.sources.tables import stored

SF = "/root/testdata/sf0.001"


def _alone(spark, labels, sizes=None, seed=audit.SEED):
    """b: (n_trials, n_pass, best_trial) of one grouping by the plain path, and its number of regimes."""
    s = audit.scores(spark, SF)
    pop = labels.join(s.select("unit").distinct(), "unit", "left_semi").select("unit", "regime")
    k = pop.select("regime").distinct().count()
    budgets = audit.BUDGETS if sizes is None else [int(r.b) for r in sa.budget_grid(pop, sizes).filter("feasible").collect()]
    draws = sa.draw_balanced(pop, budgets, audit.TRIALS, seed)
    front = re_.frontier(fi.joint_event(fi.constraints(fi.trial_stats(draws, s), fi.tolerances(s, audit.TAU_C, audit.TAU_KS))))
    return {r.b: (k, r.n_trials, r.n_pass, r.best_trial) for r in front.collect()}


def _rows(df, where):
    return {r.b: (r.k, r.n_trials, r.n_pass, r.best_trial) for r in df.filter(where).collect()}


def test_group_ablation(spark):
    got = clusters.QUERIES["f9_group_ablation"](spark, SF).cache()
    kinds = {(r.feature_group, r.kind) for r in got.collect()}  # but for those with a regime that is below every budget
    every = {(g, k) for g in [*clusters.GROUPS, "other"] for k in ("alone", "left_out")}
    assert kinds <= every and {("quantity", "alone"), ("price", "left_out")} <= kinds
    desc, named = stored(descriptors(spark, SF), "descriptors"), [c for g in clusters.GROUPS.values() for c in g]
    rest = [c for c in clusters.FEATURES if c not in named]
    for group, kind, cols in (("quantity", "alone", clusters.GROUPS["quantity"]), ("price", "left_out", [c for c in named + rest if c not in clusters.GROUPS["price"]])):
        labels = rg.cluster_regimes(rg.scaled(desc, cols), 4, 42).select("unit", F.col("cluster").cast("string").alias("regime"))
        assert _rows(got, (F.col("feature_group") == group) & (F.col("kind") == kind)) == _alone(spark, labels)


def test_cluster_counts_and_their_index(spark):
    got = clusters.QUERIES["j12_cluster_counts"](spark, SF).cache()
    v = clusters.parts(spark, SF)
    labels = {k: rg.cluster_regimes(v, k, 42).select("unit", F.col("cluster").cast("string").alias("regime")) for k in (4, 6)}
    assert _rows(got, "grouping = 4") == _alone(spark, labels[4], clusters.SIZES)
    four, six = ({r.unit: r.regime for r in labels[k].collect()} for k in (4, 6))
    same = lambda d, a, b: d[a] == d[b]
    pairs = list(combinations(sorted(four), 2))
    i, j, both = sum(same(four, *p) for p in pairs), sum(same(six, *p) for p in pairs), sum(same(four, *p) and same(six, *p) for p in pairs)
    chance = i * j / len(pairs)
    ari = {r.grouping: r.ari for r in got.select("grouping", "ari").distinct().collect()}
    assert ari[4] == pytest.approx((both - chance) / ((i + j) / 2 - chance), abs=1e-9) and ari[6] == 1


def test_cluster_seeds(spark):
    got = {(r.grouping, r.seed): (r.size, r.most_pass) for r in clusters.QUERIES["j11_cluster_seeds"](spark, SF).collect()}
    assert got.keys() == {(g, s) for g in (0, 1, 2) for s in audit.SEEDS}
    labels = rg.cluster_regimes(clusters.parts(spark, SF), 6, 1).select("unit", F.col("cluster").cast("string").alias("regime"))
    alone = _alone(spark, labels, seed=audit.SEEDS[1])
    assert got[1, audit.SEEDS[1]][1] == max(n for _, _, n, _ in alone.values())
