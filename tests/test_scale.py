"""What avoids pairs, draws and listings, against brute force."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from subsieve.operators import descriptors as de
from subsieve.operators import fidelity as fi
from subsieve.operators import optimize as op
from subsieve.operators import profile as pr
from subsieve.operators import regimes as rg
from subsieve.operators import sampling as sa
from subsieve.sources import listing as ls
from subsieve.sources.trials import TrialStore, fingerprint
from subsieve.streaming.store import LatestStore


def _components(p, r):
    root = list(range(len(p)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(p)):
        dx, dy = p[i, 0] - p[:i, 0], p[i, 1] - p[:i, 1]
        for j in np.flatnonzero(dx * dx + dy * dy <= r * r):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(p))]


@pytest.mark.parametrize("name", ["uniform", "touching grid", "cells apart", "copies"])
def test_radius_components(spark, name):
    rng = np.random.default_rng(1)
    p, r = {
        "uniform": (rng.random((300, 2)) * 14, 0.8),
        "touching grid": (np.array([(i % 12, i // 12) for i in range(144)], float), 1.0),
        "cells apart": (np.concatenate([rng.random((80, 2)) * 0.7, rng.random((80, 2)) * 0.7 + [1.69, 0]]), 1.0),
        "copies": (np.repeat(rng.random((20, 2)) * 5, 5, 0), 0.7),
    }[name]
    d = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(len(p), None, 1.0)], "unit long, x double, y double")
    assert [x.root for x in rg.radius_components(d, r).orderBy("unit").collect()] == [*_components(p, r), len(p)]


def test_a_full_cell_makes_no_pairs(spark):
    d = spark.range(300_000).select(F.col("id").alias("unit"), (F.rand(1) * 0.7).alias("x"), (F.rand(2) * 0.7).alias("y"))
    assert rg.radius_components(d, 1.0).agg(F.count_distinct("root")).first()[0] == 1  # 45,000,000,000 pairs


def test_medoids_by_bounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(700, 6)), rng.normal(size=(500, 6)) * 0.2 + 4, rng.normal(size=(60, 6)) * rng.pareto(1.5, size=(60, 1)), np.ones((5, 6))])
    label = np.repeat([0, 1, 2, 3], [700, 500, 60, 5])
    asked, sums = [], rg.distance_sums

    def counted(*args, **kw):
        asked.append(kw["asked"].count())
        return sums(*args, **kw)

    monkeypatch.setattr(rg, "distance_sums", counted)
    got = {r.label: (r.unit, r.total) for r in rg.reps_medoid(spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "unit long, label int, v array<double>")).collect()}
    for k in range(4):
        at = np.flatnonzero(label == k)
        s = np.sqrt(((x[at, None] - x[None, at]) ** 2).sum(2)).sum(1).round(6)
        assert got[k][0] == at[s.argmin()] and got[k][1] == pytest.approx(s.min(), abs=1e-5)
    assert sum(asked) < 0.1 * len(x)


def test_shell_bounds_hold():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 40):
        x = rng.normal(size=(200, d)) * rng.pareto(1.5, size=(200, 1))
        r = np.sqrt((x**2).sum(1))
        shell = np.searchsorted(np.quantile(r, [0.3, 0.6, 0.9]), r)
        low = sum(rg.Shell.sum([rg.Shell.of(x[shell == k], r[shell == k]).packed()]).least(x) for k in range(4))
        assert (low <= np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).sum(1) * (1 + 1e-9)).all()


def test_focus_by_moments(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for scene, n in enumerate((30, 30, 25, 5, 1, 20)):
        c, d = rng.normal(size=(2, n, 3))
        d /= np.linalg.norm(d, axis=1)[:, None]
        if scene == 1:  # nearly parallel, to and fro
            d = np.array([0, 0, 1.0]) + rng.normal(size=(n, 3)) * 2e-3
            d /= np.linalg.norm(d, axis=1)[:, None]
            d[::2] *= -1
        if scene == 2:
            d *= rng.uniform(0.05, 2, size=(n, 1))
        if scene == 3:
            d[:] = d[0]
        if scene == 5:
            d[3], d[4] = 0, d[5]
        f, total = np.zeros(3), 0
        for i in range(n):
            for j in range(n):
                cross = np.cross(d[i], d[j])
                if i != j and (w := cross @ cross) > 1e-5:
                    f += w * c[i] + np.cross(c[j] - c[i], d[j]) @ cross * d[i]
                    total += w
        if total:
            want[scene] = [*f / total, total]
        rows += [(scene, i, *map(float, c[i]), *map(float, d[i])) for i in range(n)]
    got = de.focus_point(spark.createDataFrame(rows, "scene int, image int, cx double, cy double, cz double, dx double, dy double, dz double"))
    got = {r.scene: [r.fx, r.fy, r.fz, r.weight] for r in got.collect()}
    assert got.keys() == want.keys() == {0, 1, 2, 5}
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)


def test_trial_store(spark, tmp_path):
    scores = spark.range(400).select(F.col("id").alias("unit"), (F.col("id") % 2).cast("string").alias("regime"), F.lit("m").alias("method"), F.lit("x").alias("metric"), (F.sin("id") * 3).alias("value"))
    alloc = sa.allocate_equal(scores.select("unit", "regime"), [3, 5])
    store = TrialStore(spark, f"file://{tmp_path}/store", 4)
    first = store.get(scores, alloc, 20, 7)
    second = store.get(scores.repartition(5), alloc, 20, 7)  # in any order
    assert not first.hit and second.hit and first.key == second.key
    want = fi.trial_stats(sa.draw_balanced(scores.select("unit", "regime"), [3, 5], 20, 7), scores)
    order = ["b", "trial", "method", "metric"]
    assert second.trials.orderBy(order).select(want.columns).collect() == want.orderBy(order).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # both are bucketed alike
    try:
        plan = second.draws.join(second.ranked, "unit")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    changed = scores.withColumn("value", F.when(F.col("unit") == 17, 0.0).otherwise(F.col("value")))
    assert not store.get(changed, alloc, 20, 7).hit and not store.get(scores, alloc, 20, 8).hit and not store.get(scores, alloc, 19, 7).hit
    store.forget(first.key)
    assert not store.get(scores, alloc, 20, 7).hit
    half = f"{tmp_path}/store/{first.key}/whole"
    os.rename(half, f"{half}-not")  # as if the driver was lost before it
    assert not store.get(scores, alloc, 20, 7).hit and store.get(scores, alloc, 20, 7).hit


def test_fingerprints(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    same = fingerprint(d.select("y", "x").repartition(2))
    assert fingerprint(d) == same and fingerprint(d.union(d.limit(1))) != same and fingerprint(d.withColumn("y", F.lit("a"))) != same and fingerprint(d.withColumn("x", F.col("x").cast("long"))) != same


def test_file_cache_over_real_folders(spark, tmp_path):
    root, cache = f"file://{tmp_path}/scenes", f"file://{tmp_path}/cache"
    for unit, files in {"s1": ["transforms.json", "sparse/txt/images.txt", "masks/a.png"], "s2": ["transforms.json", "masks/a.png"], "s3": ["transforms.json", "sparse/txt/images.txt"], "s4": ["transforms.json", "sparse/txt/images.txt", "alpha/b.png"]}.items():
        for f in files:
            path = tmp_path / "scenes" / unit / f
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps({"frames": []}) if f.endswith("json") else "x")
    (tmp_path / "scenes/s4/transforms.json").write_text("[1")
    listed = ls.list_files(spark, root)
    assert "content" not in listed._jdf.queryExecution().optimizedPlan().toString().partition("FileScan")[2]
    assert listed.count() == 10 and {r.file for r in listed.collect()} == {"transforms.json", "images.txt", "a.png", "b.png"}
    files = ls.unit_files(listed, r"/([^/]+)/(transforms\.json|sparse/txt/images\.txt|masks|alpha)(?:/|$)")
    required = [("transforms", ["transforms.json"]), ("images", ["sparse/txt/images.txt"]), ("masks", ["masks", "alpha"])]
    codes = {r.unit: r.error_code for r in ls.first_missing(files.select("unit"), files, required).collect()}
    assert codes == {"s1": None, "s2": "missing_images", "s3": "missing_masks", "s4": None}
    texts = ls.read_whole(spark, root, "*.json")
    assert texts.count() == 4 and [r.path.split("/")[-2] for r in ls.invalid_json(texts).collect()] == ["s4"]
    frames = lambda: ls.unit_files(ls.list_files(spark, root, "*.json"), r"/([^/]+)/(transforms\.json)").select("unit", "path", "modified")
    run = lambda params="p", version=1: [d.count() for d in ls.plan_work(frames(), ls.load_cache(spark, cache, "unit string, n int", version), params, version)]
    assert run() == [0, 4]
    _, left = ls.plan_work(frames(), ls.load_cache(spark, cache, "unit string, n int", 1), "p", 1)
    ls.keep(left.select(*ls.KEYS, "unit", F.lit(1).alias("n")), cache, 1)
    assert run() == [4, 0] and run("q") == [0, 4] and run(version=2) == [0, 4]
    path = tmp_path / "scenes/s2/transforms.json"
    os.utime(path, (path.stat().st_atime, path.stat().st_mtime + 5))
    assert run() == [3, 1]


def test_swaps_by_index_equal_a_full_scan(spark):
    rng = np.random.default_rng(6)
    tol = {"x": 0.5, "y": 2.0}
    rows = [(i, f"r{i % 3}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)) * [1, 5] + [3, 10])]
    wide = spark.createDataFrame(rows, "unit long, regime string, x double, y double")
    starts = {run: list(range(run, 150, 13 + run)) for run in (0, 1, 2)}
    subsets = spark.createDataFrame([(run, i, f"r{i % 3}") for run, some in starts.items() for i in some], "run int, unit long, regime string")
    members, traces, tried = op.refine_runs(wide, subsets, tol, 5)
    v, t = np.array([r[2:] for r in rows]), np.array(list(tol.values()))
    for run, some in starts.items():
        cur, trace = set(some), []
        objective = lambda c: float((np.abs(v[sorted(c)].mean(0) - v.mean(0)) / t).sum())
        trace.append(objective(cur))
        for _ in range(5):
            o, new, out = min((round(objective(cur - {a} | {b}), 12), b, a) for a in cur for b in range(150) if b not in cur and a % 3 == b % 3)
            if o >= trace[-1] - 1e-9:
                break
            cur = cur - {out} | {new}
            trace.append(objective(cur))
        assert traces[run] == pytest.approx(trace, abs=1e-9)
        assert {r.unit for r in members.filter(F.col("run") == run).collect()} == cur
    assert max(tried) < 0.2 * 3 * 12 * 46  # of a full scan's pairs
    best, trace = op.refine_restarts(wide, subsets.filter("run = 0").select("unit", "regime"), tol, 5, restarts=2)
    assert trace[-1] <= traces[0][-1] and best.count() == len(starts[0])


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 500))
    x[:, 3] = 1e6 + x[:, 4] * 1e-3  # a large mean
    x[:, 5] = 2.5
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:40, 6] = np.nan
    names = [f"c{i:03}" for i in range(500)]
    d = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {(r.a, r.b): r["corr"] for r in pr.correlation_long(d, names).collect()}
    want = pd.DataFrame(x, columns=names).corr()
    assert len(got) == 500 * 499 // 2
    for (a, b), r in got.items():
        w = None if "c005" in (a, b) else want.loc[a, b]
        assert (r is None) == (w is None) and (r is None or abs(r - w) < 1e-6)
    none = pr.correlation_long(d.limit(0), names[:3]).collect()
    assert [(r.a, r.b, r["corr"]) for r in none] == [("c000", "c001", None), ("c000", "c002", None), ("c001", "c002", None)]


def test_latest_store(spark, tmp_path):
    schema = "unit string, method string, seq long, value double"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    store = LatestStore(spark, f"file://{tmp_path}", rows().schema, buckets=4)
    now = lambda: {(r.unit, r.method): (r.seq, r.value) for r in store.rows().collect()}
    assert now() == {} and store.merge() == []
    store.add(rows(*[(f"u{i}", "m", 1, float(i)) for i in range(20)]), 0)
    assert store.merge() == [0, 1, 2, 3] and store.batches() == [] and len(now()) == 20
    files = lambda: {p.parent.name: p.stat().st_mtime_ns for p in tmp_path.glob("merged/bucket=*/*.parquet")}
    before = files()
    store.add(rows(("u3", "m", 5, 50.0), ("u3", "m", 4, 40.0)), 1)
    assert now()["u3", "m"] == (5, 50.0)
    hit = store.merge()
    assert len(hit) == 1 and {b for b, t in files().items() if before[b] != t} == {f"bucket={hit[0]}"}  # the other buckets stay as they are
    store.add(rows(("u3", "m", 2, 20.0), ("u4", "m", 1, 4.0)), 2)  # late and older, and known already
    want = now()
    store.merge()
    store.add(rows(("u3", "m", 2, 20.0), ("u4", "m", 1, 4.0)), 2)  # the same batch again, after it was merged
    assert now() == want and want["u3", "m"] == (5, 50.0) and len(want) == 20
    store.merge()
    assert now() == want


def test_files_are_written_listed_and_read_by_tasks(spark, tmp_path):
    root = f"file://{tmp_path}/many"
    texts = {f"unit={i}/asset={a}/part-0.txt": f"{a}{i}" for i in range(300) for a in ("frames", "points")} | {"unit=x/_hidden/part-0.txt": "h", "unit=x/.part-1.txt": "h", "top.txt": "ü"}
    assert ls.write_files(spark.createDataFrame(list(texts.items()), "path string, text string"), root) == len(texts)
    seen = {f"{root}/{p}": f"{t}\n" for p, t in texts.items() if "hidden" not in p and "/.part" not in p}
    listed = ls.list_files(spark, root)
    assert {r.path: r.size for r in listed.collect()} == {p: len(t.encode()) for p, t in seen.items()}
    assert {r.path: r.text for r in ls.texts_of(listed, root).collect()} == seen
    assert ls.list_files(spark, root, "top.*").count() == 1
    was = {r.path: r.modified for r in listed.collect()}
    assert ls.write_files(spark.createDataFrame([("unit=7/asset=frames/part-0.txt", "new")], "path string, text string"), root) == 1
    assert [r.path for r in ls.list_files(spark, root).collect() if was[r.path] != r.modified] == [f"{root}/unit=7/asset=frames/part-0.txt"]
    assert not list(tmp_path.glob("many/**/_temporary")) and not list(tmp_path.glob("many/**/*.crc"))  # no writer's folders or moves


def test_equal_means_are_one_value_in_any_order(spark, tmp_path):
    """Parts with the same 32 prices in other orders, and shares on a tie, beside the query's SQL."""
    import duckdb
    from compare import plain

    from subsieve.plans import profiles

    rng = np.random.default_rng(5)
    cents = rng.integers(90_000, 10_000_000, 32)
    cents[0] += 1 - cents.sum() % 2  # an odd sum: a tie
    rows = [(part, float(c) / 100) for part in range(200) for c in rng.permutation(cents)] + [(200 + i, 1000.0 + i) for i in range(56)]
    pd.DataFrame(rows, columns=["l_partkey", "l_extendedprice"]).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"p_partkey": range(256)}).to_parquet(tmp_path / "part.parquet")
    got = profiles.c16(spark, str(tmp_path)).toPandas()
    assert len(got) == 57 and got["value"].max() == (20000 * int(cents.sum()) + 32) // 64 / 1e9
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert plain(got).equals(plain(con.sql(profiles.SQL["c16_ecdf_table"]).df()))


def test_distance_sums_of_copies_and_far_vectors(spark):
    """By products of matrices, but exact for copies and near ones beside far larger vectors; few, large blocks."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2500, 6)) + 1000
    v[::5] = v[0]
    v[1::5] = v[1] + rng.normal(size=(500, 6)) * 1e-6
    rows = pd.DataFrame({"unit": range(2500), "label": np.arange(2500) % 5, "v": v.tolist()})
    got = rg.distance_sums(spark.createDataFrame(rows)).toPandas().set_index(["unit", "other"]).sort_index()
    for unit in (0, 1, 6, 2499):
        far = np.sqrt(((v - v[unit]) ** 2).sum(1))
        for other in range(5):
            inside = (np.arange(2500) % 5 == other) & (np.arange(2500) != unit)
            assert got.loc[(unit, other), "n"] == inside.sum()
            assert got.loc[(unit, other), "total"] == pytest.approx(far[inside].sum(), rel=1e-9, abs=1e-15)
    assert len(rg._sums(v[:3], v, np.eye(5)[rows["label"]])) == 3


def test_line_items_are_read_once_for_scores_and_once_for_descriptors(spark, monkeypatch):
    """What each written table reads: the line items, then only what was made of them."""
    from subsieve.plans import audit, clusters
    from subsieve.sources import tables

    sf, read = "/root/testdata/sf0.001", []

    def seen(df, tag, keep=False):
        read.append(any("lineitem" in f for f in df.inputFiles()))
        return tables.stored(df, tag, keep)

    monkeypatch.setattr(audit, "stored", seen)
    monkeypatch.setattr(clusters, "stored", seen)
    assert audit.scores(spark, sf).count() and read == [True, False]
    assert clusters.parts(spark, sf).count() and read == [True, False, True, False]
