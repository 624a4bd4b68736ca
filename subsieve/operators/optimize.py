"""Subsets made better step by step (L). The driver holds the choice of each step only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hash48, positions
from ..sources.tables import stored

FETCHED = 64 << 20  # bytes of drawn vectors that facility location holds on the driver, about

def refine_swap(wide: DataFrame, subset: DataFrame, tol: dict[str, float], iterations: int = 20, candidates: int | None = None, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """The subset (unit, regime), and its objective before and after each swap.

    wide: unit, regime, the metrics in tol. Each iteration swaps the member and the unit of its regime (of `candidates` of
    them by hash, if given) that lower the objective most, the sum of gaps of the metrics' means over tolerances, if any
    do; members are unique.
    """
    wide = stored(wide.select("unit", "regime", *tol).na.drop(), "pool")
    members, traces, _ = refine_runs(wide, subset.select(F.lit(0).alias("run"), "unit", "regime"), tol, iterations, candidates, seed)
    return members.select("unit", "regime"), traces[0]


def refine_restarts(wide: DataFrame, subset: DataFrame, tol: dict[str, float], iterations: int = 20, restarts: int = 4, candidates: int | None = None, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """The best of refine_swap from the subset and from `restarts` subsets drawn by hash, of as many units of each regime;
    all descend at once."""
    wide, subset = stored(wide.select("unit", "regime", *tol).na.drop(), "pool"), stored(subset.select("unit", "regime"), "members")
    sizes = subset.groupBy("regime").agg(F.count_distinct("unit").alias("_n"))
    runs = wide.join(F.broadcast(sizes), "regime").withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(restarts)))) if restarts else None
    starts = subset.select(F.lit(0).alias("run"), "unit", "regime")
    if restarts:
        w = Window.partitionBy("run", "regime").orderBy(hash48(F.lit(seed), F.col("run"), F.col("unit")), "unit")
        starts = starts.unionByName(runs.withColumn("_at", F.row_number().over(w)).filter("_at <= _n").select("run", "unit", "regime"))
    members, traces, _ = refine_runs(wide, starts, tol, iterations, candidates, seed)
    best = min(traces, key=lambda r: (traces[r][-1], r))
    return members.filter(F.col("run") == best).select("unit", "regime"), traces[best]


def refine_runs(wide: DataFrame, subsets: DataFrame, tol: dict[str, float], iterations: int, candidates: int | None = None, seed: int = 0) -> tuple[DataFrame, dict[int, list[float]], list[int]]:
    """(members (run, unit, regime), objectives of each run before and after each swap, pairs that each iteration tried).

    With a member out, the metrics of one unit would close all gaps, and the objective after a swap is the distance to
    it, in tolerances. So the best swap is a nearest unit to one of these, one for each member and run, and it is looked
    for in a grid over the metrics, with cells as wide as the radius: all units within the radius are in the cells around.
    A radius that holds none is made four times wider, up to where no swap improves. All runs share each reading of the
    units; only members, as few as their budgets, are broadcast, and a swap for each run comes to the driver.
    """
    spark, metrics = wide.sparkSession, list(tol)
    mean = wide.agg(*[F.avg(m) for m in metrics]).first()
    members = stored(wide.join(F.broadcast(subsets.select("run", "unit").distinct()), "unit").select("run", "unit", "regime", *metrics), "members")

    def state() -> dict[int, tuple]:
        rows = members.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"s{i}") for i, m in enumerate(metrics)]).collect()  # a row for each run
        return {r["run"]: (r["n"], [r[f"s{i}"] for i in range(len(metrics))], sum(abs(r[f"s{i}"] - mean[i]) / tol[m] for i, m in enumerate(metrics))) for r in rows}

    now = state()
    traces, tried, going = {run: [x[2]] for run, x in now.items()}, [], set(now)
    for step in range(iterations):
        pool = wide
        if candidates is not None:
            w = Window.partitionBy("regime").orderBy(hash48(F.lit(seed + step), F.col("unit")), "unit")
            pool = stored(wide.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= candidates).drop("_at"), "pool")
        limit = {run: now[run][0] * now[run][2] for run in going}  # beyond it no swap improves
        radius, open_, found, pairs = max(limit.values(), default=0) / 64, set(going), {}, 0
        while open_ and radius > 0:
            for r in _swaps(spark, pool, members, metrics, tol, mean, now, open_, radius).collect():
                pairs += r["tried"]
                if r["best"] is not None:
                    found[r["run"]] = r["best"]
            open_ = {run for run in open_ if run not in found and radius < limit[run]}
            radius *= 4
        tried.append(pairs)
        found = {run: x for run, x in found.items() if x["o"] < traces[run][-1] - 1e-9}
        going &= found.keys()
        if not going:
            break
        gone = spark.createDataFrame([(run, x["out"]) for run, x in found.items()], members.select("run", "unit").schema)
        new = spark.createDataFrame([(run, x["unit"], x["regime"], *[x[m] for m in metrics]) for run, x in found.items()], members.schema)
        members = stored(members.join(F.broadcast(gone), ["run", "unit"], "left_anti").select(*members.columns).unionByName(new), "members")  # a row for each run
        now = state()
        for run in found:
            traces[run].append(now[run][2])
    return members.select("run", "unit", "regime"), traces, tried


def _swaps(spark, pool: DataFrame, members: DataFrame, metrics: list[str], tol: dict[str, float], mean, now: dict[int, tuple], runs: set[int], radius: float) -> DataFrame:
    """run, best (o, unit, out, regime and the unit's metrics; null if none is within the radius), tried: swaps of the runs."""
    sums = spark.createDataFrame([(run, now[run][0], *now[run][1]) for run in sorted(runs)], "run int, n long, " + ", ".join(f"s{i} double" for i in range(len(metrics))))
    out = members.join(F.broadcast(sums), "run").select("run", "n", "regime", F.col("unit").alias("out"), *[F.col(m).alias(f"o{i}") for i, m in enumerate(metrics)], *[f"s{i}" for i in range(len(metrics))])
    width = [radius * tol[m] for m in metrics]
    for i in range(len(metrics)):
        need = F.col(f"o{i}") + (F.lit(mean[i]) - F.col(f"s{i}")) * F.col("n")
        out = out.withColumn(f"t{i}", need).withColumn(f"g{i}", F.floor(need / width[i])).withColumn(f"g{i}", F.explode(F.array(*[F.col(f"g{i}") + d for d in (-1, 0, 1)])))
    units = pool.select("unit", "regime", *metrics, *[F.floor(F.col(m) / width[i]).alias(f"g{i}") for i, m in enumerate(metrics)])
    p = units.join(F.broadcast(out), ["regime", *[f"g{i}" for i in range(len(metrics))]])
    p = p.join(F.broadcast(members.select("run", "unit")), ["run", "unit"], "left_anti")
    o = F.round(sum((F.abs(F.col(f"s{i}") + (F.col(m) - F.col(f"o{i}")) / F.col("n") - F.lit(mean[i])) / tol[m] for i, m in enumerate(metrics)), F.lit(0.0)), 12)
    near = sum((F.abs(F.col(m) - F.col(f"t{i}")) / tol[m] for i, m in enumerate(metrics)), F.lit(0.0)) <= radius
    best = F.min(F.when(near, F.struct(o.alias("o"), "unit", "out", "regime", *metrics)))
    return p.groupBy("run").agg(best.alias("best"), F.count(F.lit(1)).alias("tried"))


def facility_location(vectors: DataFrame, size: int, pool: int, runs: int, seed: int = 0) -> DataFrame:
    """run, step, unit: greedy facility location of several runs at once over vectors (unit, v of one length).

    Each step draws `pool` units for each run, of those that it hasn't chosen, and takes the one that makes the sum of
    distances to the nearest chosen unit least (ties by unit). Copies of a chosen unit may be drawn. Draws are places in
    the order of a hash of the unit, so they don't depend on how rows lie. Each step is one job that reads the vectors once
    and keeps nothing for each unit: the drawn and chosen vectors, runs x (pool + size) of them, are broadcast, and sums
    come back. What is drawn is known ahead, so the drawn vectors of several steps are fetched together.
    """
    spark = vectors.sparkSession
    placed = stored(positions(vectors.select("unit", "v"), [], "unit").select("pos", "unit", "v"), "placed")
    n = placed.count()
    taken: list[list[int]] = [[] for _ in range(runs)]
    held: dict[int, tuple] = {}
    chosen = []
    steps = min(size, n)
    # which units are left out is known later, so as many more are drawn as can have been taken by then
    ahead = [[_draw(np.random.default_rng([seed, run, step]), n, pool + step) for run in range(runs)] for step in range(steps)]
    at_once = max(1, FETCHED // max(1, 8 * runs * (pool + size) * _width(placed)))  # steps whose drawn vectors are fetched together
    for step in range(steps):
        if step % at_once == 0:
            need = {p for some in ahead[step : step + at_once] for d in some for p in d} | {p for t in taken for p in t}
            rows = placed.join(F.broadcast(spark.createDataFrame([(p,) for p in sorted(need)], "pos long")), "pos").toArrow()
            held = {p: (u, v) for p, u, v in zip(rows["pos"].to_pylist(), rows["unit"].to_pylist(), _matrix(rows["v"].combine_chunks()), strict=True)}
        drawn = [[p for p in ahead[step][run] if p not in taken[run]][:pool] for run in range(runs)]
        stack = lambda places: np.array([held[p][1] for p in places])
        both = spark.sparkContext.broadcast([(stack(d), stack(t) if t else None) for d, t in zip(drawn, taken, strict=True)])
        sums = placed.select("v").mapInArrow(_nearest_sums(both), "run int, place int, total double").groupBy("run", "place").agg(F.sum("total").alias("total"))
        best: dict[int, tuple] = {}
        for r in sums.collect():  # runs x pool rows
            p = drawn[r["run"]][r["place"]]
            best[r["run"]] = min(best.get(r["run"], (float("inf"),)), (round(r["total"], 9), held[p][0], p))
        for run, (_, unit, p) in sorted(best.items()):
            taken[run].append(p)
            chosen.append((run, step, unit))
        both.unpersist()
    return spark.createDataFrame(chosen, f"run int, step int, unit {vectors.schema['unit'].dataType.simpleString()}")


def _width(vectors: DataFrame) -> int:
    return vectors.select(F.size("v")).first()[0]


def _draw(random: np.random.Generator, n: int, k: int) -> list[int]:
    """`k` different places below n, or all of them in random order."""
    if n < 4 * k:
        return random.permutation(n).tolist()
    out: dict[int, None] = {}
    while len(out) < k:
        out[int(random.integers(n))] = None
    return list(out)


def _matrix(v: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def _nearest_sums(both):
    """For each run and drawn vector: the sum over a batch of the distance to the nearest of the chosen ones and it."""

    def far(x, c):
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)))

    def run(batches):
        totals: list = []
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                found = [(far(x, c) if t is None else np.minimum(far(x, c), far(x, t).min(1)[:, None])).sum(0) for c, t in both.value]
                totals = found if not totals else [a + f for a, f in zip(totals, found, strict=True)]
        if totals:
            run_, place = np.repeat(np.arange(len(totals)), [len(t) for t in totals]), np.concatenate([np.arange(len(t)) for t in totals])
            yield pa.RecordBatch.from_arrays([pa.array(run_, pa.int32()), pa.array(place, pa.int32()), pa.array(np.concatenate(totals))], ["run", "place", "total"])

    return run


def regime_coverage(pop: DataFrame, subset: DataFrame, thin: int = 3) -> DataFrame:
    """regime, total, selected, pct, thin: regimes without selected units too."""
    d = pop.join(subset.select("unit", F.lit(1).alias("s")).distinct(), "unit", "left")
    d = d.groupBy("regime").agg(F.count(F.lit(1)).alias("total"), F.count("s").alias("selected"))
    return d.select("regime", "total", "selected", F.round(100 * F.col("selected") / F.col("total"), 6).alias("pct"), (F.col("selected") < thin).alias("thin"))
