"""Column expressions and distributed order statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

Z95 = 1.959963984540054  # two-sided normal quantile at confidence 0.95
BUCKETS = 256
SMALL = 4096  # values of a group that one task sorts
ACCURACY = 1000  # of the sketches that bracket quantiles: a rank is off by one in so many at most


def wilson_lcb(k: Column, n: Column, z: float = Z95) -> Column:
    """Lower Wilson bound of k passes in n; 0 where n is not positive, never below 0."""
    p, zz = k / n, z * z
    low = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0)


def adjusted_skewness(c) -> Column:
    """Sample skewness with the small-sample factor; null below three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def ks_critical(n: Column, m: Column) -> Column:
    return 1.358 * F.sqrt((n + m) / (n * m))


def rounded_ratio(a: Column, n: Column, digits: int = 9) -> Column:
    """a / n of whole numbers, rounded half away from zero in whole numbers, so no tie is left to the last bit of a double;
    null where n is 0."""
    wide = lambda c: F.abs(c).cast("decimal(25,0)")
    r = F.call_function("div", 2 * wide(a) * F.lit(10**digits).cast("decimal(11,0)") + wide(n), F.when(n != 0, 2 * wide(n)))
    return F.signum(a.cast("double")) * F.signum(n.cast("double")) * r / float(10**digits)


def to_double(c) -> Column:
    """A number, or null for what isn't one; NaN is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def signed_log10(c: Column) -> Column:
    return F.signum(c) * F.log10(1 + F.abs(c))


def hash48(*parts) -> Column:
    """48 bits of MD5 over the parts joined by '|', as a number; DuckDB has the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def positions(df: DataFrame, by: list[str], key: str, name: str = "pos", rows_per_bucket: int = 4096) -> DataFrame:
    """Place of each row among those with the same `by`, from 0, in order of MD5(key), then key.

    A group isn't sorted by one task: hash buckets are, and small sums over buckets give what comes before each.
    """
    n = df.count()
    buckets = max(1, min(65536, -(-n // rows_per_bucket)))
    h = df.withColumn("_h", F.md5(F.col(key).cast("string")))
    h = h.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 4), 16, 10).cast("long") * buckets / 65536))
    sizes = h.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)) - 1
    return h.withColumn("_at", local).join(sizes, [*by, "_b"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_h", "_b", "_at", "_before")


def running_sums(c: DataFrame, by: list[str], value: str, cols: list[str], buckets: int = BUCKETS) -> DataFrame:
    """c with upto_<col>: sums of each col over the rows of the same `by` whose value is at most this row's.

    `c` has a row for each value. A group of more than SMALL values is cut into ranges at approximate quantiles, so that
    each holds about as many whatever the values are, outliers and infinities too; a task sorts a range, and sums over
    ranges are small.
    """
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = c.groupBy(*by).agg(F.when(F.count(F.lit(1)) > SMALL, F.percentile_approx(value, shares, F.lit(20 * buckets))).alias("_cuts"))
    c = c.join(cuts, by) if by else c.crossJoin(cuts)
    c = c.withColumn("_b", F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda q: q < F.col(value)))))
    sums = c.groupBy(*by, "_b").agg(*[F.sum(x).alias(f"_s_{x}") for x in cols])
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(*by, "_b", *[(F.sum(f"_s_{x}").over(upto) - F.col(f"_s_{x}")).alias(f"_before_{x}") for x in cols])
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.select("*", *[F.sum(x).over(inside).alias(f"_in_{x}") for x in cols]).join(sums, [*by, "_b"])
    for x in cols:
        c = c.withColumn(f"upto_{x}", F.col(f"_before_{x}") + F.col(f"_in_{x}"))
    return c.drop("_b", "_cuts", *[f"_in_{x}" for x in cols], *[f"_before_{x}" for x in cols])


def running_counts(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, value, c, lt, le, n for each different non-null value: how many rows have it, less, at most it, and all."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    n = c.groupBy(*by).agg(F.sum("c").alias("n"))
    c = running_sums(c, by, value, ["c"])
    c = c.join(n, by) if by else c.crossJoin(n)
    return c.select(*by, value, "c", (F.col("upto_c") - F.col("c")).alias("lt"), F.col("upto_c").alias("le"), "n")


def quantiles(df: DataFrame, by: list[str], qs: dict[str, float], value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation of the non-null values, one column for each name in qs.

    Groups of at most SMALL values are aggregated as they are. Of the others a sketch of bounded size brackets each wanted
    rank; one scan then counts what lies below the brackets and hands on the values inside, a few in a thousand. Only
    these are shuffled. The sketch's error is bounded by its accuracy; should a rank lie outside its bracket all the same,
    the job fails instead of returning another value.
    """
    d, group = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), [*by]
    if not by:
        d, group = d.withColumn("_all", F.lit(0)), ["_all"]
    large = stored(d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SMALL), "large")
    out = _small_quantiles(d.join(large, group, "left_anti"), group, qs)
    if not large.isEmpty():
        out = out.unionByName(_bracketed_quantiles(d.join(large, group), group, qs))
    return out.select(*by, *qs)


def _small_quantiles(d: DataFrame, group: list[str], qs: dict[str, float]) -> DataFrame:
    d = d.groupBy(*group).agg(F.sort_array(F.collect_list("_v")).alias("_v"))

    def one(q: float) -> Column:
        p = (F.size("_v") - 1) * F.lit(q)
        low, high = (F.col("_v")[f(p).cast("int")] for f in (F.floor, F.ceil))
        return F.when(high > low, low + (high - low) * (p - F.floor(p))).otherwise(low)

    return d.select(*group, *[one(q).alias(name) for name, q in qs.items()])


def _bracketed_quantiles(d: DataFrame, group: list[str], qs: dict[str, float]) -> DataFrame:
    """Of d (group, _v, _n), _n being the number of values of the group."""
    order = sorted(qs, key=qs.get)
    shares = [qs[name] for name in order]
    margin = 3 / ACCURACY
    low, high = ([F.lit(min(1.0, max(0.0, q + m))) for q in shares] for m in (-margin, margin))
    k = len(order)
    cuts = d.groupBy(*group).agg(F.first("_n").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", F.array(*low, *high), F.lit(ACCURACY)).alias("_s"))
    ends = [F.col("_min") if q <= margin else F.col("_s")[i] for i, q in enumerate(shares)], [F.col("_max") if q >= 1 - margin else F.col("_s")[k + i] for i, q in enumerate(shares)]
    cuts = stored(cuts.select(*group, "_n", F.array(*ends[0]).alias("_low"), F.array(*ends[1]).alias("_high")), "brackets")

    # a row says how many brackets lie above it (as -1 less that), and again which ones hold it
    above = F.size(F.filter("_low", lambda x: x > F.col("_v")))
    inside = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("_low")[i] <= F.col("_v")) & (F.col("_v") <= F.col("_high")[i]))
    told = F.concat(F.array(F.struct((-1 - above).alias("i"), F.lit(None).cast("double").alias("x"))), F.transform(inside, lambda i: F.struct(i.alias("i"), F.col("_v").alias("x"))))
    c = d.drop("_n").join(cuts, group).select(*group, F.explode(told).alias("_t")).groupBy(*group, "_t.i", "_t.x").agg(F.count(F.lit(1)).alias("_c"))
    c = stored(c, "inside")
    # brackets are in order, so bracket i lies above what has more than k - 1 - i above it
    below = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.aggregate("_zones", F.lit(0).cast("long"), lambda s, z: s + F.when(z["above"] > k - 1 - i, z["c"]).otherwise(0)))
    zones = c.filter("i < 0").groupBy(*group).agg(F.collect_list(F.struct((-1 - F.col("i")).alias("above"), F.col("_c").alias("c"))).alias("_zones"))  # k + 1 at most
    start = zones.join(cuts, group).select(*group, "_n", F.posexplode(below).alias("i", "_below"))

    c = running_sums(c.filter("i >= 0"), [*group, "i"], "x", ["_c"]).join(start, [*group, "i"])
    place = (F.col("_n") - 1) * F.array(*[F.lit(q) for q in shares])[F.col("i")]
    upto = F.col("_below") + F.col("upto__c")

    def at(p: Column) -> Column:
        return F.max(F.when((upto - F.col("_c") <= p) & (p < upto), F.col("x")))

    c = c.withColumn("_p", place)
    one = c.groupBy(*group, "i").agg(at(F.floor("_p")).alias("_a"), at(F.ceil("_p")).alias("_b"), F.max("_p").alias("_p"))
    found = F.col("_a") + F.when(F.col("_b") > F.col("_a"), (F.col("_b") - F.col("_a")) * (F.col("_p") - F.floor("_p"))).otherwise(0.0)
    one = one.withColumn("_q", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), found).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")))
    return one.groupBy(*group).agg(*[F.max(F.when(F.col("i") == order.index(name), F.col("_q"))).alias(name) for name in qs])


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, name, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
