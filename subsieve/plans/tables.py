"""Queries for cleaning, alignment and ranking (B, G, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import to_double, unpivot
from ..operators import align as al
from ..operators import clean as cl
from ..operators import ranking as rk
from ..operators import sampling as sa
from ..sources.tables import load
from . import audit
from .audit import BASE, runtime, sql, wide_scores

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


# ---- B


@query("b1_canonicalize", "SELECT p_partkey::VARCHAR AS id, p_retailprice AS psnr, p_size::DOUBLE AS ssim, NULL::DOUBLE AS lpips FROM part")
def b1(spark, sf):
    d = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("Scene ID"), F.col("p_retailprice").alias("psnr avgmse"), F.lit(0.0).alias("PSNR_AVG-MSE"), F.col("p_size").alias("SSIM"))
    spec = {"id": ["dish_id", "scene id"], "psnr": ["psnr_avgmse", "psnr"], "ssim": ["ssim"], "lpips": ["lpips"]}
    return cl.canonicalize(d, spec, ["id", "psnr"], ["psnr", "ssim", "lpips"])


MESSY = "CASE WHEN p_size % 7 = 0 THEN 'n/a' WHEN p_size % 11 = 0 THEN 'NaN' ELSE p_size::VARCHAR END"


def messy(spark, sf) -> DataFrame:
    p = load(spark, sf, "part")
    text = F.when(F.col("p_size") % 7 == 0, "n/a").when(F.col("p_size") % 11 == 0, "NaN").otherwise(F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("regime"), text.alias("text"), F.col("p_retailprice").alias("price"), "p_brand")


MESSY_SQL = f"m AS (SELECT p_partkey AS unit, p_type AS regime, {MESSY} AS text, p_retailprice AS price, p_brand FROM part), v AS (SELECT *, CASE WHEN text IN ('n/a', 'NaN') THEN NULL ELSE text::DOUBLE END AS value FROM m)"


@query("b2_to_double", f"WITH {MESSY_SQL} SELECT unit, value FROM v")
def b2(spark, sf):
    return messy(spark, sf).select("unit", to_double("text").alias("value"))


@query("b3_extract_id", "SELECT p_partkey, CASE WHEN regexp_extract(p_brand, '#(\\d)1', 1) <> '' THEN regexp_extract(p_brand, '#(\\d)1', 1) ELSE trim(p_brand) END AS id FROM part")
def b3(spark, sf):
    return load(spark, sf, "part").select("p_partkey", cl.extract_id(F.concat(F.lit(" "), "p_brand", F.lit(" ")), r"#(\d)1").alias("id"))


def valued(spark, sf) -> DataFrame:
    return messy(spark, sf).withColumn("value", to_double("text"))


@query("b4_drop_incomplete", f"WITH {MESSY_SQL} SELECT unit, regime, value FROM v WHERE value IS NOT NULL AND trim(regime) <> ''")
def b4(spark, sf):
    return cl.drop_incomplete(valued(spark, sf).select("unit", "regime", "value"), ["unit", "regime"], ["value"])


@query("b5_collapse_mean", "SELECT l_partkey AS unit, round(avg(l_quantity), 6) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1")
def b5(spark, sf):
    d = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"))
    return cl.collapse_mean(d, ["unit"], ["qty", "disc"]).select("unit", F.round("qty", 6).alias("qty"), F.round("disc", 6).alias("disc"))


@query("b5_keep_first", "SELECT l_partkey AS unit, l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag) = 1")
def b5_first(spark, sf):
    d = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("unit"), "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return cl.keep_first(d, ["unit"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"]).drop("l_suppkey")


@query("b6_stable_schema", "SELECT p_partkey AS unit, NULL::DOUBLE AS a_feat, p_retailprice, p_size FROM part")
def b6(spark, sf):
    d = load(spark, sf, "part").select("p_size", "p_retailprice", F.col("p_partkey").alias("unit"))
    return cl.stable_schema(d, ["unit"], ["a_feat", "p_size"]).orderBy("unit")


@query("b7_impute_mean", f"WITH {MESSY_SQL} SELECT unit, round(coalesce(value, (SELECT avg(value) FROM v)), 6) AS value FROM v")
def b7(spark, sf):
    return cl.impute_mean(valued(spark, sf).select("unit", "value"), ["value"]).select("unit", F.round("value", 6).alias("value"))


@query("b8_drop_constant", f"WITH {MESSY_SQL} SELECT unit, value, price FROM v")
def b8(spark, sf):
    d = valued(spark, sf).select("unit", "value", "price", F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"))
    return cl.drop_constant(d, ["value", "price", "same", "none"])


@query("b9_drop_sparse", f"WITH {MESSY_SQL} SELECT unit, price FROM v")
def b9(spark, sf):
    return cl.drop_sparse(valued(spark, sf).select("unit", "value", "price"), ["value", "price"], 0.9)


# ---- G


def regimes(spark, sf) -> DataFrame:
    return load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("regime"))


def of_method(spark, sf, m: str) -> DataFrame:
    return wide_scores(spark, sf).filter(F.col("method") == m).drop("method")


@query("g1_population", sql(BASE, "SELECT p_partkey AS unit, p_type AS regime, price, disc, qty FROM part JOIN sc ON p_partkey = unit AND method = 'R'"))
def g1(spark, sf):
    return al.population(regimes(spark, sf), of_method(spark, sf, "R"), ["price", "disc", "qty"])


SPLIT = f"split AS (SELECT unit, CASE WHEN pos < round_even(n * 0.6, 0) THEN 'selection' WHEN pos < round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'tune' ELSE 'test' END AS split FROM (SELECT p_partkey AS unit, count(*) OVER (PARTITION BY p_type) AS n, row_number() OVER (PARTITION BY p_type ORDER BY md5('{audit.SEED}|' || p_partkey::VARCHAR), '{audit.SEED}|' || p_partkey::VARCHAR) - 1 AS pos FROM part))"


@query("g2_combined", sql(BASE, audit.RUNTIME, SPLIT, "SELECT unit, regime, price, qty, runtime FROM (SELECT p_partkey AS unit, p_type AS regime FROM part) JOIN (SELECT unit, price FROM sc WHERE method = 'R') USING (unit) JOIN (SELECT unit, qty FROM sc WHERE method = 'N') USING (unit) LEFT JOIN rt USING (unit) JOIN split USING (unit) WHERE split = 'tune'"))
def g2(spark, sf):
    m = regimes(spark, sf)
    split = sa.stratified_split(m, 0.6, 0.2, audit.SEED).filter("split = 'tune'")
    return al.combined(m, of_method(spark, sf, "R").select("unit", "price"), of_method(spark, sf, "N").select("unit", "qty"), runtime(spark, sf), split)


EV = "e AS (SELECT user_id AS unit, event_type AS method, 'value' AS metric, round(avg(value), 9) AS value FROM events GROUP BY ALL UNION ALL SELECT user_id, event_type, 'count', count(*)::DOUBLE FROM events GROUP BY ALL)"
COMMON = "c AS (SELECT unit FROM e GROUP BY unit HAVING count(DISTINCT method) = 5)"
METHODS = "(SELECT count(DISTINCT method) FROM e)"


def event_scores(spark, sf) -> DataFrame:
    e = load(spark, sf, "events").groupBy(F.col("user_id").alias("unit"), F.col("event_type").alias("method"))
    return unpivot(e.agg(F.round(F.avg("value"), 9).alias("value"), F.count(F.lit(1)).alias("count")), ["unit", "method"], ["value", "count"], "metric", "v").withColumnRenamed("v", "value")


@query("g3_common_ids", f"WITH {EV}, {COMMON} SELECT * FROM c")
def g3(spark, sf):
    return al.common_ids(event_scores(spark, sf), 5)


@query("g4_restrict", f"WITH {EV}, {COMMON} SELECT e.* FROM e JOIN c USING (unit)")
def g4(spark, sf):
    e = event_scores(spark, sf)
    return al.restrict(e, al.common_ids(e, 5)).select("unit", "method", "metric", "value")


@query("g5_missing_per_method", sql(BASE, "SELECT DISTINCT method, unit FROM raw WHERE unit NOT IN (SELECT unit FROM scores)"))
def g5(spark, sf):
    raw = audit.raw_scores(spark, sf)
    return al.missing_per_method(raw, al.common_ids(raw, 3))


COVER = sql(BASE, "cv AS (SELECT metric, method, count(*) AS n_full, count(*) FILTER (unit % 5 = 0) AS n_subset, count(*) FILTER (unit IN (SELECT unit FROM pop)) AS n_shared, count(*) FILTER (unit % 5 = 0 AND unit IN (SELECT unit FROM pop)) AS n_shared_subset FROM raw GROUP BY ALL)", "SELECT * FROM cv")


def _cover(spark, sf) -> DataFrame:
    raw = audit.raw_scores(spark, sf)
    return al.coverage(raw, raw.filter("unit % 5 = 0").select("unit"), al.common_ids(raw, 3))


@query("g6_coverage", COVER)
def g6(spark, sf):
    return _cover(spark, sf)


@query("g6_coverage_range", COVER.replace("SELECT * FROM cv", "SELECT method, min(n_full) AS least_full, max(n_full) AS most_full, min(n_subset) AS least_subset, max(n_subset) AS most_subset FROM cv GROUP BY method"))
def g6b(spark, sf):
    return al.coverage_range(_cover(spark, sf))


@query("g7_coverage_bias", """
WITH d AS (SELECT documents.doc_id, lang AS regime, n_chars::DOUBLE AS value, l.doc_id IS NOT NULL AS side FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
c AS (SELECT value, count(*) FILTER (side) AS a, count(*) FILTER (NOT side) AS b FROM d GROUP BY value),
r AS (SELECT sum(a) OVER (ORDER BY value) / sum(a) OVER () - sum(b) OVER (ORDER BY value) / sum(b) OVER () AS x FROM c),
t AS (SELECT count(*) FILTER (side) AS n_covered, count(*) FILTER (NOT side) AS n_missing, avg(value) FILTER (side) - avg(value) FILTER (NOT side) AS gap FROM d)
SELECT n_covered, n_missing, round(gap, 6) AS gap, (SELECT round(max(abs(x)), 9) FROM r) AS ks, abs(gap) > 200 AS gap_over, (SELECT round(max(abs(x)), 9) FROM r) > 0.14 AS ks_over,
       (SELECT round(max(abs(a::DOUBLE / n_covered - b::DOUBLE / n_missing)), 9) FROM (SELECT count(*) FILTER (side) AS a, count(*) FILTER (NOT side) AS b FROM d GROUP BY regime)) AS max_share_shift FROM t""")
def g7(spark, sf):
    pop = load(spark, sf, "documents").select(F.col("doc_id").alias("unit"), F.col("lang").alias("regime"), F.col("n_chars").cast("double").alias("value"))
    return al.coverage_bias(pop, load(spark, sf, "labels").select(F.col("doc_id").alias("unit")), 200.0, 0.14)


@query("g8_split_filter", sql(SPLIT, "SELECT p_partkey AS unit, p_size FROM part JOIN split ON unit = p_partkey WHERE split = 'test'"))
def g8(spark, sf):
    split = sa.stratified_split(regimes(spark, sf), 0.6, 0.2, audit.SEED)
    return al.split_filter(load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), "p_size"), split, "test")


@query("g9_regime_support", "SELECT p_type AS regime, count(*) AS n, count(*) >= 320 AS supported FROM part GROUP BY p_type")
def g9(spark, sf):
    return al.regime_support(regimes(spark, sf), 320)


@query("g10_align_methods", sql(BASE, "SELECT unit, max(value) FILTER (method = 'A') AS A, max(value) FILTER (method = 'N') AS N, max(value) FILTER (method = 'R') AS R FROM scores WHERE metric = 'qty' GROUP BY unit"))
def g10(spark, sf):
    return al.align_methods(audit.raw_scores(spark, sf).filter("metric = 'qty'"), ["A", "N", "R"])


# ---- K: event types as methods, users as units


MM = [EV, COMMON, "mm AS (SELECT metric, method, count(value) AS n_full, count(value) FILTER (unit % 4 = 1) AS n_subset, avg(value) AS full_mean, avg(value) FILTER (unit % 4 = 1) AS subset_mean FROM e JOIN c USING (unit) GROUP BY ALL)"]


def _means(spark, sf) -> DataFrame:
    e = event_scores(spark, sf)
    e = al.restrict(e, al.common_ids(e, 5))
    return rk.method_means(e, e.filter("unit % 4 = 1").select("unit"))


@query("k1_method_means", sql(*MM, "SELECT metric, method, n_full, n_subset, round(full_mean, 6) AS full_mean, round(subset_mean, 6) AS subset_mean FROM mm"))
def k1(spark, sf):
    return _means(spark, sf).select("metric", "method", "n_full", "n_subset", F.round("full_mean", 6).alias("full_mean"), F.round("subset_mean", 6).alias("subset_mean"))


def ranks_sql(v: str, name: str) -> str:
    return f"{name} AS (SELECT metric, method, dense_rank() OVER w AS dense, rank() OVER w + (count(*) OVER (PARTITION BY metric, round(-{v}, 9)) - 1) / 2.0::DOUBLE AS average, row_number() OVER (PARTITION BY metric ORDER BY round(-{v}, 9), method) AS ordinal FROM mm WINDOW w AS (PARTITION BY metric ORDER BY round(-{v}, 9)))"


RANKS = [*MM, ranks_sql("full_mean", "fr"), ranks_sql("subset_mean", "sr")]


@query("k2_rank_methods", sql(*RANKS, "SELECT metric, method, dense, average::DOUBLE AS average, ordinal FROM fr"))
def k2(spark, sf):
    return rk.rank_methods(_means(spark, sf), "full_mean").select("metric", "method", "dense", "average", "ordinal")


def _both(spark, sf) -> DataFrame:
    m = _means(spark, sf)
    f = rk.rank_methods(m, "full_mean").select("metric", "method", F.col("average").alias("f"))
    return f.join(rk.rank_methods(m, "subset_mean").select("metric", "method", F.col("average").alias("s")), ["metric", "method"])


@query("k3_spearman", sql(*RANKS, "SELECT metric, round(corr(fr.average, sr.average), 9) AS rho FROM fr JOIN sr USING (metric, method) GROUP BY metric"))
def k3(spark, sf):
    return rk.correlation_of_ranks(_both(spark, sf), "f", "s", ["metric"])


BOTH = [*RANKS, "b AS (SELECT metric, method, fr.average AS f, sr.average AS s FROM fr JOIN sr USING (metric, method))"]


@query("k4_kendall", sql(*BOTH, "SELECT x.metric, round(sum(sign(x.f - y.f) * sign(x.s - y.s)) / sqrt(sum(abs(sign(x.f - y.f))) * sum(abs(sign(x.s - y.s)))), 9) AS tau FROM b x JOIN b y ON x.metric = y.metric AND x.method < y.method GROUP BY x.metric"))
def k4(spark, sf):
    return rk.kendall(_both(spark, sf), ["metric"], "f", "s")


@query("k4_kendall_units", f"WITH {EV}, w AS (SELECT unit, max(value) FILTER (method = 'click') AS f, max(value) FILTER (method = 'view') AS s FROM e WHERE metric = 'value' GROUP BY unit HAVING count(*) FILTER (method IN ('click', 'view')) = 2) SELECT 'value' AS metric, round(sum(sign(round(x.f - y.f, 9)) * sign(round(x.s - y.s, 9))) / sqrt(sum(abs(sign(round(x.f - y.f, 9)))) * sum(abs(sign(round(x.s - y.s, 9))))), 9) AS tau FROM w x JOIN w y ON x.unit < y.unit")
def k4_units(spark, sf):
    w = al.align_methods(event_scores(spark, sf).filter("metric = 'value'").filter(F.col("method").isin("click", "view")), ["click", "view"])
    return rk.kendall(w.withColumn("metric", F.lit("value")), ["metric"], "click", "view")


@query("k5_pairwise_agreement", sql(*BOTH, "SELECT x.metric, count(*) AS n_pairs, round(avg((sign(x.f - y.f) = sign(x.s - y.s))::INT), 9) AS agreement FROM b x JOIN b y ON x.metric = y.metric AND x.method < y.method GROUP BY x.metric"))
def k5(spark, sf):
    return rk.pairwise_agreement(_both(spark, sf), "f", "s", ["metric"])


@query("k6_top_agreement", sql(*MM, "t AS (SELECT *, full_mean >= max(full_mean) OVER (PARTITION BY metric) - 0.5 AS f, subset_mean >= max(subset_mean) OVER (PARTITION BY metric) - 0.5 AS s FROM mm)", "SELECT metric, string_agg(method, ',' ORDER BY method) FILTER (f) AS full_top, string_agg(method, ',' ORDER BY method) FILTER (s) AS subset_top, bool_or(f AND s) AS agree FROM t GROUP BY metric"))
def k6(spark, sf):
    return rk.top_agreement(_means(spark, sf), 0.5)


@query("k7_method_table", sql(EV, "t AS (SELECT metric, method, count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM e GROUP BY ALL)", "o AS (SELECT metric, string_agg(method, '>' ORDER BY round(-m, 9), method) AS ordering FROM t GROUP BY metric)", "SELECT metric, method, n, round(m, 6) AS mean, round(sd, 6) AS sd, ordering FROM t JOIN o USING (metric)"))
def k7(spark, sf):
    return rk.method_table(event_scores(spark, sf))


@query("k8_rank_match", sql(*RANKS, "SELECT metric, bool_and(fr.ordinal = sr.ordinal) AS order_kept, bool_and(fr.dense = sr.dense) AS exact_match FROM fr JOIN sr USING (metric, method) GROUP BY metric"))
def k8(spark, sf):
    return rk.rank_match(_means(spark, sf))
