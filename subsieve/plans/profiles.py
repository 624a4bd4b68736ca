"""Queries for profiles and transforms (C, D): descriptors of parts from their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rounded_ratio
from ..operators import profile as pr
from ..operators import sampling as sa
from ..sources.tables import load, stored
from .audit import sql

QUERIES: dict = {}
SQL: dict = {}
FEATURES = ["disc_avg", "events_like", "price_avg", "price_sd", "qty_max", "qty_min", "retail", "size", "tax_zero"]


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


DESC = """
desc_ AS (SELECT unit, regime, retail, size, price_avg, price_sd, qty_min, qty_max, CASE WHEN unit % 9 = 0 THEN NULL ELSE disc_avg END AS disc_avg,
                 tax_zero, events_like FROM
  (SELECT l_partkey AS unit, round(avg(l_extendedprice) / 1000, 9) AS price_avg, round(stddev_pop(l_extendedprice) / 1000, 9) AS price_sd, min(l_quantity) AS qty_min,
          max(l_quantity) AS qty_max, round(avg(l_discount), 9) AS disc_avg, (count(*) FILTER (l_tax = 0))::DOUBLE AS tax_zero,
          round(exp(max(l_tax) * 40 + (l_partkey % 5)), 6) AS events_like FROM lineitem GROUP BY l_partkey)
  JOIN (SELECT p_partkey AS unit, p_type AS regime, p_retailprice AS retail, p_size::DOUBLE AS size FROM part) USING (unit)),
lf AS (""" + " UNION ALL ".join(f"SELECT unit, regime, '{f}' AS feature, {f} AS value FROM desc_" for f in FEATURES) + ")"


def descriptors(spark, sf) -> DataFrame:
    r = lambda c, n=9: F.round(c, n)
    li = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(
        r(F.avg("l_extendedprice") / 1000).alias("price_avg"), r(F.stddev_pop("l_extendedprice") / 1000).alias("price_sd"), F.min("l_quantity").alias("qty_min"),
        F.max("l_quantity").alias("qty_max"), r(F.avg("l_discount")).alias("disc_avg"), F.count_if(F.col("l_tax") == 0).cast("double").alias("tax_zero"), F.max("l_tax").alias("tax"),
    )
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("regime"), F.col("p_retailprice").alias("retail"), F.col("p_size").cast("double").alias("size"))
    d = li.join(p, "unit").withColumn("disc_avg", F.when(F.col("unit") % 9 != 0, F.col("disc_avg")))
    return d.withColumn("events_like", r(F.exp(F.col("tax") * 40 + F.col("unit") % 5), 6)).drop("tax")


def long_table(spark, sf, ids=()) -> DataFrame:
    return stored(pr.long_form(descriptors(spark, sf), FEATURES, list(ids)), "long")


def rounded(df: DataFrame, keep: list[str], n: int = 6) -> DataFrame:
    return df.select(*[F.col(c) if c in keep or t not in ("double", "float") else F.round(c, n).alias(c) for c, t in df.dtypes])


QS = "qs AS (SELECT feature, count(*) AS rows, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, min(value) AS min, max(value) AS max FROM lf GROUP BY feature)"
OUT = "ou AS (SELECT feature, count(*) FILTER (round(value, 9) < round(q1 - 1.5 * (q3 - q1), 9) OR round(value, 9) > round(q3 + 1.5 * (q3 - q1), 9)) AS outliers, round(100.0 * count(*) FILTER (round(value, 9) < round(q1 - 1.5 * (q3 - q1), 9) OR round(value, 9) > round(q3 + 1.5 * (q3 - q1), 9)) / count(*), 6)::DOUBLE AS outlier_pct FROM lf JOIN qs USING (feature) GROUP BY feature)"


@query("c1_feature_summary", sql(DESC, QS, OUT, "SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(min, 6) AS min, round(max, 6) AS max, round(100.0::DOUBLE * (rows - n) / rows, 6) AS missing_pct, outliers, outlier_pct FROM qs JOIN ou USING (feature)"))
def c1(spark, sf):
    return rounded(pr.feature_summary(long_table(spark, sf)), [])


@query("c2_outlier_stats", sql(DESC, QS, OUT, "SELECT * FROM ou"))
def c2(spark, sf):
    d = long_table(spark, sf)
    return pr.outlier_stats(d, pr.quantiles(d, ["feature"], pr.QUARTILES))


STATS = "SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, CASE WHEN stddev_samp(value) > 0 THEN skewness(value) END AS skew FROM {} GROUP BY feature"


@query("c3_inspect_features", sql(DESC, "s AS (" + STATS.format("lf") + ")", "SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(skew, 6) + 0.0 AS skew FROM s"))
def c3(spark, sf):
    return rounded(pr.inspect_features(long_table(spark, sf)), [])


MISS = "mi AS (SELECT feature, round(100.0::DOUBLE * (count(*) - count(value)) / count(*), 6) AS missing_pct FROM lf GROUP BY feature)"


@query("c4_missingness", sql(DESC, MISS, "SELECT feature, missing_pct, CASE WHEN missing_pct = 0 THEN 'complete' WHEN missing_pct = 100 THEN 'absent' ELSE 'partial' END AS status FROM mi"))
def c4(spark, sf):
    return pr.missingness(long_table(spark, sf))


CORR = "co AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM desc_" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + ")"


@query("c5_correlation", sql(DESC, CORR, "SELECT a, b, round(corr, 6) AS corr FROM co"))
def c5(spark, sf):
    return rounded(pr.correlation_long(descriptors(spark, sf), FEATURES), [])


@query("c6_top_correlated", sql(DESC, CORR, "SELECT a, b, round(corr, 6) AS corr FROM co WHERE corr IS NOT NULL ORDER BY round(abs(corr), 9) DESC, a, b LIMIT 5"))
def c6(spark, sf):
    return rounded(pr.top_correlated(pr.correlation_long(descriptors(spark, sf), FEATURES), 5), [])


CODE = "CASE WHEN html NOT LIKE '%</html>%' THEN 'cut' WHEN length(html) < 1500 THEN 'short' WHEN url LIKE '%?%' THEN 'query' END"


def failures(spark, sf) -> DataFrame:
    code = F.when(~F.col("html").contains("</html>"), "cut").when(F.length("html") < 1500, "short").when(F.col("url").contains("?"), "query")
    return load(spark, sf, "pages").select("page_id", code.alias("error_code"))


@query("c7_failure_summary", f"SELECT {CODE} AS error_code, count(*) AS n FROM pages WHERE {CODE} IS NOT NULL GROUP BY 1")
def c7(spark, sf):
    return pr.failure_summary(failures(spark, sf))


LI = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]
YEARS = "ly AS (SELECT *, (SELECT min(l_shipdate) + (max(l_shipdate) - min(l_shipdate)) / 2 FROM lineitem) AS mid FROM lineitem)"


def halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Line items of even and of odd ship years."""
    d = load(spark, sf, "lineitem")
    d = d.withColumn("l_tax", F.when((F.year("l_shipdate") % 2 == 1) | (F.col("l_linenumber") != 1), F.col("l_tax")))
    return d.filter(F.year("l_shipdate") % 2 == 0), d.filter(F.year("l_shipdate") % 2 == 1)


HALF = "h AS (SELECT * REPLACE (CASE WHEN year(l_shipdate) % 2 = 1 OR l_linenumber <> 1 THEN l_tax END AS l_tax), year(l_shipdate) % 2 = 0 AS cur FROM lineitem), hl AS (" + " UNION ALL ".join(f"SELECT cur, '{f}' AS feature, {f} AS value FROM h" for f in LI) + ")"


@query("c8_drift", sql(HALF, "x AS (SELECT feature, avg(value) FILTER (cur) - avg(value) FILTER (NOT cur) AS dm, 100.0::DOUBLE * count(*) FILTER (cur AND value IS NULL) / count(*) FILTER (cur) - 100.0::DOUBLE * count(*) FILTER (NOT cur AND value IS NULL) / count(*) FILTER (NOT cur) AS dx FROM hl GROUP BY feature)", "SELECT feature, round(dm, 6) AS mean_delta, round(dx, 6) AS missing_delta, abs(dm) >= 1 OR abs(dx) >= 5 AS changed FROM x"))
def c8(spark, sf):
    cur, base = halves(spark, sf)
    return pr.drift(pr.long_form(cur, LI), pr.long_form(base, LI), 1.0, 5.0)


@query("c8_correlation_drift", sql(HALF, "d AS (" + " UNION ALL ".join(f"SELECT abs(corr({a}, {b}) FILTER (cur) - corr({a}, {b}) FILTER (NOT cur)) AS d FROM h" for i, a in enumerate(LI) for b in LI[i + 1 :]) + ")", "SELECT count(d) AS n_pairs, round(avg(d), 6) AS mean_change, round(max(d), 6) AS max_change FROM d"))
def c8_corr(spark, sf):
    cur, base = halves(spark, sf)
    return pr.correlation_drift(pr.correlation_long(cur, LI), pr.correlation_long(base, LI))


@query("c9_quality_gate", sql(DESC, MISS, f"SELECT round(failed, 9) AS failed_share, worst AS worst_missing, failed <= 0.2 AS failed_ok, worst <= 5 AS missing_ok FROM (SELECT count({CODE})::DOUBLE / count(*) AS failed FROM pages), (SELECT max(missing_pct) AS worst FROM mi)"))
def c9(spark, sf):
    f = failures(spark, sf).withColumn("failed", F.col("error_code").isNotNull().cast("int"))
    return pr.quality_gate(f, F.count(F.lit(1)), pr.missingness(long_table(spark, sf)), 0.2, 5.0)


@query("c10_winsor", sql(DESC, "w AS (SELECT feature, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM lf GROUP BY feature)", "SELECT feature, round(CASE WHEN low = high THEN low - 0.5 ELSE low END, 6) AS low, round(CASE WHEN low = high THEN high + 0.5 ELSE high END, 6) AS high, round(sign(high) * log10(1 + abs(high)), 6) AS log_high FROM w"))
def c10(spark, sf):
    from ..functions.stats import signed_log10

    w = pr.winsor_bounds(long_table(spark, sf), 0.01, 0.99)
    raw_high = F.col("high")
    return rounded(w.withColumn("log_high", signed_log10(raw_high)), [])


PROFILE = "pf AS (SELECT regime, " + ", ".join(f"round(avg({f}), 6) AS {f}" for f in FEATURES) + " FROM desc_ GROUP BY regime)"


def profile(spark, sf) -> DataFrame:
    return rounded(pr.group_profile(descriptors(spark, sf), "regime", FEATURES), [])


@query("c11_group_profile", sql(DESC, PROFILE, "SELECT * FROM pf"))
def c11(spark, sf):
    return profile(spark, sf)


@query("c12_regime_histogram", "SELECT p_type AS regime, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM part GROUP BY p_type")
def c12(spark, sf):
    return pr.regime_histogram(load(spark, sf, "part").select(F.col("p_type").alias("regime")), "regime")


@query("c13_histogram", sql(DESC, "en AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lf GROUP BY feature)", "SELECT feature, CASE WHEN hi > lo THEN least(29, floor(round((value - lo) / (hi - lo) * 30, 9))) ELSE 0 END::INT AS bin, count(*) AS n FROM lf JOIN en USING (feature) WHERE value IS NOT NULL GROUP BY ALL"))
def c13(spark, sf):
    return pr.histogram(long_table(spark, sf), 30)


@query("c14_inventory", "SELECT 'documents' AS source, count(*) AS rows, 5 AS columns, count(DISTINCT doc_id) AS distinct_ids FROM documents UNION ALL SELECT 'labels', count(*), 3, count(DISTINCT doc_id) FROM labels UNION ALL SELECT 'all', NULL, NULL, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels))")
def c14(spark, sf):
    return pr.inventory({n: load(spark, sf, n) for n in ("documents", "labels")}, "doc_id")


@query("c15_varying_features", sql(DESC, PROFILE, "u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM pf" for f in FEATURES) + ")", "SELECT feature, round(stddev_pop(value), 6) AS std FROM u GROUP BY feature ORDER BY round(stddev_pop(value), 6) DESC, feature LIMIT 4"))
def c15(spark, sf):
    return pr.varying_features(profile(spark, sf), FEATURES, 4)


# mean prices and shares from whole numbers: a mean of doubles depends on the order of rows, and with 32 line items often lies on a tie of the ninth digit
EXACT = """
cents AS (SELECT l_partkey AS unit, sum(round(l_extendedprice * 100)::BIGINT) AS s, count(l_extendedprice) AS n FROM lineitem GROUP BY 1),
c AS (SELECT sign(s) * ((20000 * abs(s) + n) // (2 * n)) / 1e9::DOUBLE AS value, count(*) AS p, count(*) FILTER (unit % 7 = 0) AS s FROM cents WHERE unit IN (SELECT p_partkey FROM part) GROUP BY 1),
u AS (SELECT value, sum(p) OVER (ORDER BY value) AS p, sum(p) OVER () AS np, sum(s) OVER (ORDER BY value) AS s, sum(s) OVER () AS ns FROM c)"""


@query("c16_ecdf_table", sql(EXACT, "SELECT value, ((2000000000 * p + np) // (2 * np))::DOUBLE / 1e9::DOUBLE AS pop_share, ((2000000000 * s + ns) // nullif(2 * ns, 0))::DOUBLE / 1e9::DOUBLE AS subset_share FROM u"))
def c16(spark, sf):
    """Shares of the parts, and of every seventh, whose mean price (in cents, so exact) is at most each value, in thousands."""
    cents = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("s"), F.count("l_extendedprice").alias("n"))
    d = cents.join(load(spark, sf, "part").select(F.col("p_partkey").alias("unit")), "unit", "left_semi")
    d = stored(d.select("unit", rounded_ratio(F.col("s"), F.col("n") * 100_000).alias("value")), "values")
    return pr.ecdf_table(d, d.filter("unit % 7 = 0"))


# ---- D

S1 = "s1 AS (" + STATS.format("i1") + ")"
IMP = "i1 AS (SELECT unit, feature, coalesce(value, avg(value) OVER (PARTITION BY feature)) AS value FROM lf)"
LOG = "lg AS (SELECT feature, coalesce(min >= 0 AND (abs(skew) > 1 OR min = 0 OR max / nullif(min, 0) > 100), false) AS log FROM s1)"
I2 = "i2 AS (SELECT unit, feature, CASE WHEN log THEN ln(1 + value) ELSE value END AS value FROM i1 JOIN lg USING (feature))"
ROB = "rb AS (SELECT feature, coalesce(abs(skew) > 1, false) AS robust FROM (" + STATS.format("i2") + "))"
NORM = [DESC, IMP, S1, LOG, I2, ROB, "st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM i2 GROUP BY feature)"]


@query("d1_select_log", sql(*NORM[:4], "SELECT * FROM lg"))
def d1(spark, sf):
    d = long_table(spark, sf, ["unit"])
    means = d.groupBy("feature").agg(F.avg("value").alias("m"))
    return pr.select_log(pr.inspect_features(d.join(means, "feature").withColumn("value", F.coalesce("value", "m"))))


@query("d2_select_scaler", sql(*NORM[:6], "SELECT * FROM rb"))
def d2(spark, sf):
    return pr.normalize(long_table(spark, sf, ["unit"]))[1].select("feature", "robust")


@query("d3_robust_scale", sql(DESC, "q AS (SELECT feature, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM lf GROUP BY feature)", "SELECT unit, feature, round((value - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) + 0.0 AS value FROM lf JOIN q USING (feature)"))
def d3(spark, sf):
    return rounded(pr.robust_scale(long_table(spark, sf, ["unit"])), [])


@query("d4_standard_scale", sql(DESC, "q AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM lf GROUP BY feature)", "SELECT unit, feature, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS value FROM lf JOIN q USING (feature)"))
def d4(spark, sf):
    return rounded(pr.standard_scale(long_table(spark, sf, ["unit"])), [])


@query("d5_clip", sql(DESC, "SELECT unit, feature, greatest(-3.0::DOUBLE, least(3.0::DOUBLE, round(value - 2, 6))) AS value FROM lf WHERE value IS NOT NULL"))
def d5(spark, sf):
    return long_table(spark, sf, ["unit"]).filter("value is not null").select("unit", "feature", pr.clip(F.round(F.col("value") - 2, 6)).alias("value"))


@query("d6_normalize", sql(*NORM, "SELECT unit, feature, round(greatest(-3.0::DOUBLE, least(3.0::DOUBLE, CASE WHEN robust THEN (value - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END ELSE (value - m) / CASE WHEN s = 0 THEN 1 ELSE s END END)), 6) + 0.0 AS value FROM i2 JOIN st USING (feature) JOIN rb USING (feature)"))
def d6(spark, sf):
    return rounded(pr.normalize(long_table(spark, sf, ["unit"]))[0].select("unit", "feature", "value"), [])


@query("d7_pool_embeddings", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS place FROM embeddings), m AS (SELECT label, place, avg(v) AS m FROM x GROUP BY ALL) SELECT label, place, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS value FROM m")
def d7(spark, sf):
    return rounded(pr.pool_embeddings(load(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")), "label", "embedding"), [])


@query("d8_select_frames", "WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS a FROM conversations), t AS (SELECT conv_id, turn, a // 2 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM s WHERE a % 2 = 0) SELECT conv_id, turn, k AS at FROM t WHERE n <= 3 OR k IN (0, (n - 1) // 2, n - 1)")
def d8(spark, sf):
    return sa.select_frames(load(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], 2, 3).select("conv_id", "turn", "at")


@query("d9_every_nth", "SELECT conv_id, turn, a AS at FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS a FROM conversations) WHERE a % 4 = 0")
def d9(spark, sf):
    return sa.every_nth(load(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], 4).select("conv_id", "turn", "at")


@query("d10_select_log_median", sql(DESC, "SELECT feature, max(value) / (quantile_cont(value, 0.5) + 1e-6) > 100 AS log FROM lf GROUP BY feature"))
def d10(spark, sf):
    return pr.select_log_median(long_table(spark, sf))
