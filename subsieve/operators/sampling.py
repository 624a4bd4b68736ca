"""Draws of units by budget and trial (H): deterministic, without replacement, and not touching units that aren't drawn.

A trial's places are hashes of (seed + b, trial, group, j) modulo the group's size, the first different ones in order of
j; where a group is smaller than twice what is taken, its places in order of their hashes. Places meet units by an
equality join on the units' place in their group, so the cost follows the draws and not the population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hash48, positions


def places(seed: Column, trial: Column, group: Column, n: Column, take: Column) -> Column:
    h = lambda j: hash48(seed, trial, group, j)
    ordered = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.struct(h(j).alias("h"), j.alias("j")))), lambda x: x["j"])
    tried = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), 4 * take + 40), lambda j: F.pmod(h(j), n)))
    # so many hashes hold enough different places but for once in 2 ** 43 draws; then, too, all places are put in order
    enough = F.transform(F.array(tried), lambda t: F.when(F.size(t) < take, ordered).otherwise(t))[0]
    return F.slice(F.when(n < 2 * take, ordered).otherwise(enough), F.lit(1), take.cast("int"))


def draw_allocated(pop: DataFrame, alloc: DataFrame, trials: int, seed: int | str, by: list[str] = ()) -> DataFrame:
    """b, trial, unit, regime: from pop (unit, regime), by alloc (b, regime, take).

    Budgets with an allocation below 1 or above its regime's size are left out. Units must be distinct. Several
    populations (groupings, generators) are drawn from at once if pop and alloc have the columns `by`, which tell them
    apart; other columns of alloc tell draws apart. The seed may be one of these. All of them come back before b.
    """
    group, extra = [*by, "regime"], [c for c in alloc.columns if c not in ("b", "regime", "take", *by)]
    placed = positions(pop.select("unit", *group), group, "unit")
    sizes = pop.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    a = alloc.join(sizes, group, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = F.max(((F.col("take") < 1) | (F.col("take") > F.col("n"))).cast("int")).over(Window.partitionBy(*by, *extra, "b"))
    a = a.withColumn("bad", bad).filter("bad = 0").drop("bad")
    a = a.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).repartition(*extra, "b", "trial", *group)
    seed_b = ((F.col(seed) if isinstance(seed, str) else F.lit(seed)) + F.col("b")).cast("long")
    drawn = a.select(*extra, "b", "trial", *group, F.explode(places(seed_b, F.col("trial"), F.col("regime"), F.col("n").cast("long"), F.col("take").cast("long"))).alias("pos"))
    return drawn.join(placed, [*group, "pos"]).select(*by, *extra, "b", "trial", "unit", "regime")


def budget_frame(pop: DataFrame, budgets: list[int], by: list[str] = ()) -> DataFrame:
    """by, b, regime, n for each budget and regime; regimes are few."""
    sizes = pop.groupBy(*by, "regime").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(*by, F.explode(F.array(*[F.lit(b) for b in budgets])).alias("b"), "regime", "n")


def allocate_equal(pop: DataFrame, budgets: list[int], by: list[str] = ()) -> DataFrame:
    return budget_frame(pop, budgets, by).select(*by, "b", "regime", F.col("b").alias("take"))


def allocate_by_size(pop: DataFrame, sizes: list[int], by: list[str]) -> DataFrame:
    """by, b, regime, take: for each population the different budgets size / regimes (half up) that its regimes can fill."""
    k = pop.groupBy(*by, "regime").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"), F.collect_list("regime").alias("regimes"))
    b = k.select(*by, "smallest", "regimes", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(s) for s in sizes]), lambda s: F.floor(s / F.col("k") + 0.5).cast("int")))).alias("b"))
    return b.filter("b >= 1 and b <= smallest").select(*by, "b", F.explode("regimes").alias("regime"), F.col("b").alias("take"))


def allocate_proportional(pop: DataFrame, budgets: list[int]) -> DataFrame:
    """b, regime, take: b x regimes units by regime size, largest remainders first, ties by regime."""
    f = budget_frame(pop, budgets)
    per_b = Window.partitionBy("b")
    f = f.withColumn("total", F.col("b") * F.count(F.lit(1)).over(per_b)).withColumn("exact", F.col("total") * F.col("n") / F.sum("n").over(per_b))
    f = f.withColumn("low", F.floor("exact")).withColumn("rest", F.round(F.col("exact") - F.col("low"), 9))
    f = f.withColumn("place", F.row_number().over(per_b.orderBy(F.desc("rest"), "regime")))
    spare = F.col("total") - F.sum("low").over(per_b)
    return f.select("b", "regime", (F.col("low") + (F.col("place") <= spare).cast("int")).cast("int").alias("take"))


def draw_balanced(pop: DataFrame, budgets: list[int], trials: int, seed: int) -> DataFrame:
    return draw_allocated(pop, allocate_equal(pop, budgets), trials, seed)


def draw_uniform(pop: DataFrame, budgets: list[int], trials: int, seed: int) -> DataFrame:
    """k x b units of all, k the number of regimes; the seed is offset by 10000."""
    k = pop.select("regime").distinct().count()
    all_ = pop.select("unit", F.lit("all").alias("regime"))
    sizes = pop.sparkSession.createDataFrame([(b, "all", k * b) for b in budgets], "b int, regime string, take int")
    return draw_allocated(all_, sizes, trials, seed + 10000).select("b", "trial", "unit").join(pop.select("unit", "regime"), "unit")


def budget_grid(pop: DataFrame, sizes: list[int]) -> DataFrame:
    """b = size / regimes, rounded half up, at least 1, each once; infeasible ones stay with a reason."""
    k = pop.groupBy("regime").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest"))
    b = k.select(F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"), "k", "smallest")
    b = b.withColumn("b", F.greatest(F.lit(1), F.floor(F.col("size") / F.col("k") + 0.5)).cast("int"))
    b = b.groupBy("b", "k", "smallest").agg(F.min("size").alias("size"))
    ok = F.col("b") <= F.col("smallest")
    return b.select("b", "size", (F.col("b") * F.col("k")).alias("units"), ok.alias("feasible"), F.when(~ok, "smallest regime is below b").alias("reason"))


def stratified_split(pop: DataFrame, selection: float, tune: float, seed: int) -> DataFrame:
    """unit, regime, split: shares of each regime by half-even rounding, the remainder is test."""
    d = pop.select("unit", "regime", F.concat_ws("|", F.lit(str(seed)), F.col("unit").cast("string")).alias("key"))
    d = positions(d, ["regime"], "key").join(pop.groupBy("regime").agg(F.count(F.lit(1)).alias("n")), "regime")
    first, second = F.bround(F.col("n") * selection), F.bround(F.col("n") * tune)
    split = F.when(F.col("pos") < first, "selection").when(F.col("pos") < first + second, "tune").otherwise("test")
    return d.select("unit", "regime", split.alias("split"))


def every_nth(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of each sequence."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("at", at).filter(F.col("at") % n == 0)


def select_frames(df: DataFrame, by: list[str], order: list[str], stride: int, k: int) -> DataFrame:
    """Every stride-th row of each sequence; of those, k spread evenly from first to last if there are more."""
    d = every_nth(df, by, order, stride).withColumn("at", (F.col("at") / stride).cast("long"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") - 1) / max(1, k - 1)))
    return d.withColumn("n", n).filter((F.col("n") <= k) | F.array_contains(spread, F.col("at"))).drop("n")
