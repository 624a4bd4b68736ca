"""Anchors, invariants and brute force for what SQL doesn't say."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subsieve.functions.graph import components
from subsieve.functions import stats
from subsieve.functions.stats import quantiles, wilson_lcb
from subsieve.operators import clean as cl
from subsieve.operators import fidelity as fi
from subsieve.operators import optimize as op
from subsieve.operators import profile as pr
from subsieve.operators import ranking as rk
from subsieve.operators import regimes as rg
from subsieve.operators import reliability as re_
from subsieve.operators import sampling as sa
from subsieve.sources import files as fs


def test_wilson_anchors(spark):
    d = spark.createDataFrame([(113, 400), (88, 400), (0, 0), (0, 10)], "k long, n long").select(wilson_lcb(F.col("k"), F.col("n")).alias("x"))
    assert [round(r.x, 12) for r in d.collect()] == [0.240610272351, 0.182173892734, 0.0, 0.0]


def test_canonical_columns(spark):
    d = spark.createDataFrame([("a7", 31.5, 28, 36, 0.93, 30.75), ("b2", 19.25, 15, 22, 0.71, 18.5)], ["dish_id", "PNSR", "MIN", "MAX", "SSIM", "psnr avgmse"])
    spec = {"id": ["dishid"], "psnr": ["psnr", "pnsr"], "low": ["psnr_min", "min"], "avg": ["psnr_avgmse"], "lpips": ["lpips"]}
    got = cl.canonicalize(d, spec, ["id"], ["psnr", "low", "avg", "lpips"])
    assert got.columns == list(spec)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("a7", 31.5, 28.0, 30.75, None), ("b2", 19.25, 15.0, 18.5, None)]
    with pytest.raises(ValueError, match="ssim"):
        cl.canonicalize(d.drop("SSIM"), {"ssim": ["ssim"]}, ["ssim"])


def test_stable_schema(spark):
    d = spark.createDataFrame([("b", "/b", 2.0, 1.0)], ["id", "path", "z", "a"])
    assert cl.stable_schema(d, ["id", "path"], ["m"]).columns == ["id", "path", "a", "m", "z"]


def test_drift_without_correlations(spark):
    cur, base = spark.createDataFrame([("f1", 7.5), ("f1", None)], "feature string, value double"), spark.createDataFrame([("f1", 5.0)], "feature string, value double")
    r = pr.drift(cur, base, 0.1, 0.1).first()
    assert (r.mean_delta, r.missing_delta, r.changed) == (2.5, 50.0, True)
    none = spark.createDataFrame([], "a string, b string, corr double")
    assert tuple(pr.correlation_drift(none, none).first()) == (0, None, None)


def population(spark, n=300):
    rnd = random.Random(3)
    rows = [(i, f"r{i % 3}", m, "x", rnd.gauss(0, 1) + (m == "b")) for i in range(n) for m in "ab"]
    return spark.createDataFrame(rows, "unit long, regime string, method string, metric string, value double").repartition(3, "unit").cache()


def test_draws(spark):
    pop = population(spark).select("unit", "regime").distinct()
    d = sa.draw_balanced(pop, [2, 90, 100, 101], 5, 1)
    sizes = {r.b: (r.n, r.d) for r in d.groupBy("b", "trial").agg(F.count("unit").alias("n"), F.count_distinct("unit").alias("d")).collect()}
    assert sizes == {2: (6, 6), 90: (270, 270), 100: (300, 300)}  # 101 is above a regime's size
    again = sa.draw_balanced(pop.repartition(7), [2], 5, 1)
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in d.filter("b = 2").collect())


def test_ks_bounds_and_full_set(spark):
    s = population(spark)
    all_ = s.select("unit").distinct().select(F.lit(0).alias("b"), F.lit(0).alias("trial"), "unit")
    assert {(r.gap, r.ks) for r in fi.trial_stats(all_, s).collect()} == {(0.0, 0.0)}
    some = fi.trial_stats(all_.filter("unit % 7 = 0"), s).collect()
    assert all(0 < r.ks <= 1 for r in some)


def test_ks_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 9) / 2, rnd.random() < 0.4) for _ in range(120)]
    a, b = ([v for v, s in rows if s is x] for x in (True, False))
    want = max(abs(sum(v <= t for v in a) / len(a) - sum(v <= t for v in b) / len(b)) for t, _ in rows)
    got = fi.ks_distance(spark.createDataFrame(rows, "value double, side boolean"), []).first()
    assert got.ks == pytest.approx(want, abs=1e-9)


def test_quantiles_equal_percentile(spark):
    rnd = random.Random(6)
    d = spark.createDataFrame([(f"f{i % 3}", rnd.choice([rnd.random(), 1.0, 100.0 * rnd.random()])) for i in range(400)] + [("f0", None)], "feature string, value double")
    got = {r.feature: (r.a, r.b) for r in quantiles(d, ["feature"], {"a": 0.25, "b": 0.9}).collect()}
    for r in d.groupBy("feature").agg(F.percentile("value", F.lit(0.25)).alias("a"), F.percentile("value", F.lit(0.9)).alias("b")).collect():
        assert got[r.feature] == pytest.approx((r.a, r.b))


def test_pareto_not_dominated(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(1, 8), rnd.randint(1, 8) / 8) for i in range(40)]
    got = {r.i for r in re_.pareto(spark.createDataFrame(rows, "i int, size int, lcb double"), "lcb", "size").collect()}
    assert got == {i for i, s, v in rows if not any(t <= s and w >= v and (t < s or w > v) for _, t, w in rows)}


def test_selector_relaxes(spark):
    d = spark.createDataFrame([(2, 12, 0.3, True, False), (4, 24, 0.6, True, False), (8, 48, 0.9, False, True)], "b int, size int, lcb double, feasible boolean, has_manifest boolean")
    assert tuple(re_.select_budget(d, 0.5, 30).first()) == (4, 24, 0.6, True, True, False)
    assert tuple(re_.select_budget(d, 0.5, 5).first())[-1] is True


def test_kendall_of_itself(spark):
    d = spark.createDataFrame([("m", i, float(i % 4)) for i in range(12)], "metric string, method int, v double")
    assert rk.kendall(d.withColumn("w", F.col("v")), ["metric"], "v", "w").first().tau == 1.0


def test_kendall_equals_brute_force(spark):
    rnd = random.Random(12)
    rows = [(g, float(rnd.randint(0, 30)), rnd.choice([None, *range(20)])) for g, n in (("x", 150), ("y", 3), ("z", 1)) for _ in range(n)] + [("c", 1.0, i) for i in range(5)]
    got = {r.g: r.tau for r in rk.kendall(spark.createDataFrame(rows, "g string, v double, w int"), ["g"], "v", "w").collect()}
    sign = lambda x: (x > 0) - (x < 0)
    for g in "xyc":
        p = [(v, w) for h, v, w in rows if h == g and w is not None]
        pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(p) for b in p[:i]]
        under = (sum(abs(s) for s, _ in pairs) * sum(abs(t) for _, t in pairs)) ** 0.5
        assert got.get(g) == (pytest.approx(sum(s * t for s, t in pairs) / under, abs=1e-8) if under else None)


def test_running_sums_with_outliers_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(stats, "SMALL", 50)
    rnd = random.Random(13)
    rows = [("hot", rnd.gauss(0, 1), rnd.randint(0, 5)) for _ in range(900)] + [("hot", v, 1) for v in (1e300, -1e300, float("inf"), float("-inf"))] + [("few", float(i), i) for i in range(9)]
    d = stats.running_sums(spark.createDataFrame(rows, "g string, v double, c long"), ["g"], "v", ["c"], buckets=16)
    for r in d.collect():
        assert r.upto_c == sum(c for g, v, c in rows if g == r.g and v <= r.v)


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, x) for x in range(401, 450)]
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}


def test_medoids_and_exact_silhouettes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rg, "BLOCK", 7)
    rnd = random.Random(14)
    rows = [(i, i % 3 if i % 10 else 0, [rnd.gauss(i % 3, 1.0) for _ in range(3)]) for i in range(60)]
    d = spark.createDataFrame(rows, "unit long, label int, v array<double>")
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    got = {r.label: (r.unit, r.total) for r in rg.reps_medoid(d).collect()}
    widths = []
    for i, k, v in rows:
        mean = {o: [far(v, w) for j, p, w in rows if p == o and j != i] for o in range(3)}
        a, b = (sum(mean[k]) / len(mean[k])), min(sum(m) / len(m) for o, m in mean.items() if o != k)
        widths.append((b - a) / max(a, b))
    for k in range(3):
        totals = {i: sum(far(v, w) for _, p, w in rows if p == k) for i, o, v in rows if o == k}
        best = min(totals, key=lambda i: (round(totals[i], 6), i))
        assert got[k] == (best, pytest.approx(totals[best], abs=1e-5))
    assert rg.silhouette_exact(d).first().silhouette == pytest.approx(sum(widths) / 60, abs=1e-5)


def test_choose_k_finds_planted_clusters(spark):
    rnd = random.Random(15)
    d = spark.createDataFrame([(i, [10.0 * (i % 4) + rnd.gauss(0, 0.3), -7.0 * (i % 4 == 2) + rnd.gauss(0, 0.3)]) for i in range(120)], "unit long, v array<double>")
    rows = {r.k: r for r in rg.choose_k(d, [2, 3, 4, 5], 1).collect()}
    assert [k for k, r in rows.items() if r.best] == [4] and rows[4].silhouette > 0.9


def test_selector_stability_counts_passes(spark):
    s = population(spark)
    all_ = [r.unit for r in s.select("unit").distinct().orderBy("unit").collect()]
    picks = spark.createDataFrame([(0, u) for u in all_] + [(1, u) for u in all_] + [(2, u) for u in all_[:3]], "run int, unit long")
    r = re_.selector_stability(picks, s, fi.tolerances(s, 0.05, 0.05)).first()
    assert (r.n_runs, r.n_pass, r.n_pairs) == (3, 2, 3) and r.mean_overlap == 1.0


def test_joint_selection_relaxes_and_breaks_ties(spark):
    kind = "k int, b int, size int, rate double, lcb double, feasible boolean, best_pass boolean, best_regime_pass boolean, silhouette double, balance double"
    row = lambda k, size, lcb, ok=True, sil=0.5, bal=0.5, feasible=True: (k, size // 10, size, lcb, lcb, feasible, ok, ok, sil, bal)
    pick = lambda rows, **kw: re_.select_joint(spark.createDataFrame(rows, kind), 0.5, **kw).first()
    base = [row(4, 40, 0.6), row(5, 40, 0.6, sil=0.7), row(6, 20, 0.4), row(7, 10, 0.9, ok=False)]
    assert pick(base).k == 5  # equal size and bound: the better silhouette
    assert pick(base, max_size=30).k == 6 and pick(base, max_size=5).k == 5  # the cap holds where something passes it
    assert pick([row(4, 40, 0.6, ok=False), row(5, 10, 0.9, feasible=False)]).k == 4  # nothing passes: all feasible ones
    assert pick([row(4, 40, 0.2), row(5, 80, 0.3, sil=None), row(6, 80, 0.3, bal=0.1)]).k == 6
    d = {r.k: r for r in re_.joint_sweep(spark.createDataFrame(base, kind), 0.5).collect()}
    assert [k for k, r in d.items() if r.pareto] == [7] and [k for k, r in d.items() if r.recommended] == [5] and d[7].rank == 1


def test_one_draw_for_several_populations(spark):
    pop = population(spark).select("unit", "regime").distinct()
    two = pop.withColumn("grouping", F.lit(1)).union(pop.select("unit", F.lit("all").alias("regime"), F.lit(2).alias("grouping")))
    d = sa.draw_allocated(two, sa.allocate_equal(two, [4], ["grouping"]), 3, 1, ["grouping"])
    alone = sa.draw_balanced(pop, [4], 3, 1)
    assert sorted(map(tuple, d.filter("grouping = 1").select(*alone.columns).collect())) == sorted(map(tuple, alone.collect()))
    assert d.filter("grouping = 2").groupBy("trial").agg(F.count_distinct("unit").alias("n")).filter("n = 4").count() == 3


def test_hull(spark):
    rnd = random.Random(4)
    p = [(rnd.random(), rnd.random()) for _ in range(60)]
    got = {(r.x, r.y) for r in rg.hull(spark.createDataFrame([("g", *q) for q in p], "label string, x double, y double"), "label").collect()}

    def corner(q):  # some line through q has all others on one side
        return any(all((b[0] - q[0]) * (c[1] - q[1]) - (b[1] - q[1]) * (c[0] - q[0]) >= 0 for c in p) for b in p if b != q)

    assert got == {q for q in p if corner(q)}


def test_swaps_never_raise_the_objective(spark):
    s = population(spark).filter("method = 'a'").select("unit", "regime", F.col("value").alias("x"))
    members, trace = op.refine_swap(s, s.filter("unit < 12").select("unit", "regime"), {"x": 0.1}, 4)
    assert all(a > b for a, b in zip(trace, trace[1:])) and members.distinct().count() == 12
    assert {r.regime: r["count"] for r in members.groupBy("regime").count().collect()} == {"r0": 4, "r1": 4, "r2": 4}


def test_facility_location_runs(spark):
    rnd = random.Random(8)
    v = spark.createDataFrame([(i, [rnd.random(), rnd.random()]) for i in range(50)], "unit long, v array<double>")
    d = op.facility_location(v, 4, 5, 2)
    assert d.groupBy("run").agg(F.count_distinct("unit").alias("n")).filter("n = 4").count() == 2


def test_strict_logs(spark, tmp_path):
    (tmp_path / "u1.json").write_text('{"method": "m", "results": {"value": 1.5}}')
    (tmp_path / "u2.json").write_text("not json")
    units = spark.createDataFrame([("u1",), ("u2",)], "unit string")
    assert [tuple(r) for r in fs.read_logs(spark, str(tmp_path)).collect()] == [("u1", "m", 1.5, None)]
    with pytest.raises(ValueError, match="1 units"):
        fs.read_logs(spark, str(tmp_path), expected=units)


def test_pca_and_clusters(spark):
    v = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100, 1.0 * (i % 3), 0.5]) for i in range(40)], "unit long, v array<double>")
    c = rg.cluster_regimes(v, 2, 1)
    assert c.groupBy((F.col("unit") % 2).alias("p")).agg(F.count_distinct("cluster").alias("n")).filter("n = 1").count() == 2
    assert rg.silhouette(c, "cluster").first().silhouette > 0.9
    assert abs(rg.project_2d(v).agg(F.sum("px")).first()[0]) < 1e-6


def test_facility_location_is_greedy(spark):
    rnd = random.Random(16)
    x = {i: [rnd.gauss(0, 1) for _ in range(3)] for i in range(40)}
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(x[a], x[b])) ** 0.5
    want: list = []
    for _ in range(5):
        want.append(min((i for i in x if i not in want), key=lambda i: (round(sum(min(far(j, c) for c in [*want, i]) for j in x), 9), i)))
    d = op.facility_location(spark.createDataFrame(list(x.items()), "unit long, v array<double>").repartition(5), 5, 40, 2)
    assert [[r.unit for r in d.filter(F.col("run") == k).orderBy("step").collect()] for k in (0, 1)] == [want, want]


def test_facility_location_takes_copies(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(6)], "unit long, v array<double>")
    d = op.facility_location(v, 6, 6, 2).collect()
    assert all(sorted(r.unit for r in d if r.run == k) == list(range(6)) for k in range(2))


def test_restarts_keep_the_best(spark):
    s = spark.createDataFrame([(i, f"r{i % 2}", float((i * 37) % 101)) for i in range(60)], "unit long, regime string, x double")
    sub = s.filter("unit < 8").select("unit", "regime")
    one, best = op.refine_swap(s, sub, {"x": 0.1}, 1), op.refine_restarts(s, sub, {"x": 0.1}, 1, restarts=2)
    assert best[1][-1] <= one[1][-1] and best[0].count() == best[0].distinct().count() == 8
    assert {r.regime: r["count"] for r in best[0].groupBy("regime").count().collect()} == {"r0": 4, "r1": 4}


def test_bracketed_quantiles_are_exact_and_shuffle_little(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = [rng.normal(size=30_000), np.round(rng.normal(size=20_000), 1), np.full(5000, 2.5), rng.pareto(0.3, size=20_000), np.append(np.full(9000, -1.0), rng.normal(size=10)), rng.normal(size=5), np.array([1.0])]
    d = pd.concat([pd.DataFrame({"g": g, "value": x}) for g, x in enumerate(groups)]).sample(frac=1, random_state=0)
    qs, rows, kept = {"lo": 0.0, "a": 0.01, "q1": 0.25, "m": 0.5, "q3": 0.75, "z": 0.999, "hi": 1.0}, {}, stats.stored

    def stored(df, tag):
        df = kept(df, tag)
        rows[tag] = df.count()
        return df

    monkeypatch.setattr(stats, "stored", stored)
    got = stats.quantiles(spark.createDataFrame(d).repartition(7), ["g"], qs).toPandas().set_index("g").sort_index()
    want = d.groupby("g")["value"].quantile(list(qs.values())).unstack()
    assert np.allclose(got[list(qs)], want, rtol=1e-12)
    assert rows["large"] == 5 and rows["inside"] < 0.05 * len(d)  # of seven quantiles
    df = spark.createDataFrame([(1, None), (2, 3.0), (2, None)], "g int, value double")
    assert [tuple(r) for r in stats.quantiles(df, ["g"], {"m": 0.5}).collect()] == [(2, 3.0)]
    assert stats.quantiles(df, [], {"m": 0.5}).first()[0] == 3.0 and stats.quantiles(df.limit(0), ["g"], {"m": 0.5}).count() == 0
