"""Queries for files, descriptors, checks and log streams (A, E, M, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators import descriptors as de
from ..operators import reliability as re_
from ..sources import files as fs
from ..sources.tables import load, scratch, stored
from ..streaming import logs as st
from ..streaming.store import LatestStore
from .audit import BASE, DRAWN, FRONT, Audit, sql, wide_scores
from .profiles import rounded

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


# ---- A


@query("a1_read_metrics", sql(BASE, "SELECT unit, method, price, disc, qty FROM sc"))
def a1(spark, sf):
    path = scratch(spark, "metrics")
    wide_scores(spark, sf).write.option("header", True).csv(path)
    return fs.read_metrics(spark, path, "unit long, method string, price double, disc double, qty double")


EVENT_MEANS = "em AS (SELECT user_id::VARCHAR AS unit, event_type AS method, round(avg(value), 9) AS value, count(*)::DOUBLE AS count FROM events GROUP BY ALL)"


def event_means(spark, sf) -> DataFrame:
    e = load(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("unit"), F.col("event_type").alias("method"))
    return e.agg(F.round(F.avg("value"), 9).alias("value"), F.count(F.lit(1)).cast("double").alias("count"))


@query("a2_read_logs", f"WITH {EVENT_MEANS} SELECT unit, method, value, count FROM em WHERE count <> 13")
def a2(spark, sf):
    path = scratch(spark, "logs")
    d = event_means(spark, sf).withColumn("value", F.when(F.col("count") != 13, F.col("value")))
    d.select("unit", "method", F.struct("value", "count").alias("results")).write.json(path)
    return fs.read_logs(spark, path, expected=d.filter("value is not null"))


@query("a3_overlay", f"WITH {EVENT_MEANS} SELECT unit, method, CASE WHEN unit::INT % 3 = 0 THEN value ELSE -1 END AS value FROM em")
def a3(spark, sf):
    d = event_means(spark, sf).select("unit", "method", "value")
    return fs.overlay([d.filter("cast(unit as int) % 3 = 0"), d.withColumn("value", F.lit(-1.0))], ["unit", "method"])


@query("a4_flatten_features", "SELECT p_partkey AS unit, p_size::DOUBLE AS size, p_retailprice AS price, round((p_size + p_size % 7 + 3) / 3.0::DOUBLE, 6) AS parts_mean, round(((p_size - (p_size + p_size % 7 + 3) / 3.0::DOUBLE) ** 2 + (p_size % 7 - (p_size + p_size % 7 + 3) / 3.0::DOUBLE) ** 2 + (3 - (p_size + p_size % 7 + 3) / 3.0::DOUBLE) ** 2) / 3, 6) AS parts_var, least(p_size, p_size % 7, 3)::DOUBLE AS parts_min, greatest(p_size, p_size % 7, 3)::DOUBLE AS parts_max, 3 AS parts_n FROM part")
def a4(spark, sf):
    p = load(spark, sf, "part")
    inner = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 2 == 1, F.col("p_size")).alias("extent"), F.array("p_size", F.col("p_size") % 7, F.lit(3)).alias("parts"))
    d = p.select(F.col("p_partkey").alias("unit"), F.to_json(F.struct(inner.alias("geometry"), F.col("p_retailprice").cast("string").alias("price"))).alias("json"))
    out = fs.flatten_features(d, "unit", "json", {"size": ["$.geometry.size", "$.geometry.extent"], "price": ["$.cost", "$.price"]}, {"parts": "$.geometry.parts"})
    return rounded(out, ["size", "price"])


@query("a4_flatten_numbers", "SELECT event_id, (props->>'$.k')::DOUBLE AS props_k, value FROM events")
def a4_numbers(spark, sf):
    d = load(spark, sf, "events").select("event_id", F.struct(F.from_json("props", "k double, name string").alias("props"), "value", "event_type").alias("r"))
    return fs.flatten_numbers(d, "event_id", "r")


@query("a5_scrape_records", """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM documents),
c AS (SELECT doc_id, line, string_split(split_part(substr(s, instr(s, 'the ') + 4), '.', 1), ' ') AS f FROM l WHERE contains(s, 'the '))
SELECT doc_id, line::INT AS line, len(f)::INT AS n_fields, trim(f[1], ' ') AS first FROM c WHERE len(f) >= 5""")
def a5(spark, sf):
    d = fs.scrape_records(load(spark, sf, "documents"), "doc_id", "text", "the ", ".", " ", 5)
    return d.select("doc_id", "line", F.size("fields").alias("n_fields"), F.col("fields")[0].alias("first"))


@query("a6_read_manifest", "SELECT DISTINCT p_brand AS unit FROM part")
def a6(spark, sf):
    return fs.read_manifest(load(spark, sf, "part").select(F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("Brand")), "Brand")


@query("a7_write_manifests", sql(*DRAWN, "SELECT b, unit, regime FROM draws WHERE trial = 0"))
def a7(spark, sf):
    path = scratch(spark, "manifests")
    fs.write_manifests(Audit(spark, sf).drawn().filter("trial = 0").select("b", "unit", "regime"), path)
    return spark.read.schema("unit long, regime string, b int").option("header", True).csv(path).select("b", "unit", "regime")


REPORT = "b int, n_trials long, n_pass long, rate double, lcb double, best_trial int, best_joint double, best_mean double, best_max_ks double"


@query("a7_write_report", " UNION ALL ".join(f"SELECT '{f}' AS format, * FROM ({sql(*FRONT, 'SELECT * FROM fr')})" for f in ("csv", "json")))
def a7_report(spark, sf):
    """The frontier as a report, written and read back in both formats."""
    front, out = stored(re_.frontier(Audit(spark, sf).events()), "frontier"), None
    for f in ("csv", "json"):
        path = scratch(spark, "report")
        fs.write_report(front, path, ["b"], f)
        d = spark.read.schema(REPORT).option("header", True).format(f).load(path)
        d = d.select(F.lit(f).alias("format"), *front.columns)
        out = d if out is None else out.union(d)
    return out


@query("a8_upsert", "SELECT p_partkey AS unit, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS size FROM part UNION ALL SELECT -p_partkey, 0 FROM part WHERE p_partkey % 4 = 0 AND p_partkey > 0")
def a8(spark, sf):
    store = load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_size").alias("size"))
    some = store.filter("unit % 4 = 0").select("unit", F.lit(0).alias("size"))
    return fs.upsert(store, some.union(some.filter("unit > 0").select(-F.col("unit"), "size")), ["unit"])


@query("a9_split_cached", "SELECT count(*) FILTER (p_partkey % 3 = 0 AND p_size % 5 <> 0) AS n_hits, count(*) FILTER (NOT (p_partkey % 3 = 0 AND p_size % 5 <> 0)) AS n_todo FROM part")
def a9(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), F.col("p_size").alias("mtime"))
    cache = p.filter("unit % 3 = 0").withColumn("version", F.when(F.col("mtime") % 5 == 0, 1).otherwise(2))
    hits, todo = fs.split_cached(p, cache, ["unit", "mtime"], 2)
    return hits.agg(F.count(F.lit(1)).alias("n_hits")).crossJoin(todo.agg(F.count(F.lit(1)).alias("n_todo")))


@query("a10_check_assets", "SELECT c_custkey AS unit, count(DISTINCT o_orderpriority)::INT AS n_assets, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') = 0 THEN 'missing_1-URGENT' WHEN count(*) FILTER (o_orderpriority = '2-HIGH') = 0 THEN 'missing_2-HIGH' END AS error_code FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def a10(spark, sf):
    units = load(spark, sf, "customer").select(F.col("c_custkey").alias("unit"))
    assets = load(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("asset"))
    return fs.check_assets(units, assets, ["1-URGENT", "2-HIGH"])


# ---- E

POINTS = "pt AS (SELECT l_partkey AS scene, l_orderkey AS point_id, l_quantity AS x, l_extendedprice AS y, l_discount AS z, l_tax AS error, l_linenumber AS track FROM lineitem)"


@query("e1_parse_points", f"WITH {POINTS} SELECT * FROM pt")
def e1_points(spark, sf):
    track = F.expr("array_join(transform(sequence(1, l_linenumber), i -> concat(i, ' 0')), ' ')")
    line = F.concat_ws(" ", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", F.lit("0 0 0"), "l_tax", track)
    text = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("scene")).agg(F.concat(F.lit("# points\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return de.parse_points_text(text).select("scene", "point_id", "x", "y", "z", "error", F.col("track").cast("int").alias("track"))


POSES = "ps AS (SELECT vec_id // 20 AS scene, vec_id AS image, embedding[1]::DOUBLE AS qw, embedding[2]::DOUBLE AS qx, embedding[3]::DOUBLE AS qy, embedding[4]::DOUBLE AS qz, embedding[5]::DOUBLE AS tx, embedding[6]::DOUBLE AS ty, embedding[7]::DOUBLE AS tz, label FROM embeddings)"


def poses(spark, sf) -> DataFrame:
    e = F.col("embedding")
    cols = [e[i].cast("double").alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))]
    return load(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("scene"), F.col("vec_id").alias("image"), *cols, "label")


@query("e1_parse_images", f"WITH {POSES} SELECT scene, image AS image_id, 'f' || image || '.png' AS name, round(qw, 6) AS qw, round(tx, 6) AS tx, (image % 4)::INT AS n_points FROM ps")
def e1_images(spark, sf):
    triples = F.expr("if(image % 4 = 0, '', array_join(transform(sequence(1, cast(image % 4 as int)), i -> concat('1.5 2.5 ', i)), ' '))")
    two = F.concat(F.concat_ws(" ", "image", "qw", "qx", "qy", "qz", "tx", "ty", "tz", F.lit("1"), F.concat(F.lit("f"), "image", F.lit(".png"))), F.lit("\n"), triples)
    text = poses(spark, sf).groupBy("scene").agg(F.concat(F.lit("# images\n"), F.array_join(F.collect_list(two), "\n")).alias("text"))
    d = de.parse_images_text(text)
    return d.select("scene", "image_id", "name", F.round("qw", 6).alias("qw"), F.round("tx", 6).alias("tx"), F.size("observations").alias("n_points"))


@query("e2_view_stats", "WITH p AS (SELECT l_partkey AS scene, l_suppkey AS image, count(*) AS k, count(*) FILTER (l_linenumber <> 3) AS v FROM lineitem GROUP BY ALL) SELECT scene, count(*) AS n_images, round(avg(v), 6) AS visible_mean, round(stddev_pop(v), 6) AS visible_std, round(avg(v::DOUBLE / k), 6) AS share_mean, round(stddev_pop(v::DOUBLE / k), 6) AS share_std FROM p GROUP BY scene")
def e2(spark, sf):
    obs = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("scene"), F.col("l_suppkey").alias("image"), F.when(F.col("l_linenumber") == 3, -1).otherwise(F.col("l_orderkey")).alias("point_id"))
    return rounded(de.view_stats(obs), [])


CAMERA = """n AS (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS q FROM ps),
u AS (SELECT scene, image, label, qw / q AS w, qx / q AS x, qy / q AS y, qz / q AS z, tx, ty, tz FROM n),
cam AS (SELECT scene, image, label, -((1 - 2 * (y * y + z * z)) * tx + 2 * (x * y + w * z) * ty + 2 * (x * z - w * y) * tz) AS cx,
               -(2 * (x * y - w * z) * tx + (1 - 2 * (x * x + z * z)) * ty + 2 * (y * z + w * x) * tz) AS cy,
               -(2 * (x * z + w * y) * tx + 2 * (y * z - w * x) * ty + (1 - 2 * (x * x + y * y)) * tz) AS cz,
               2 * (x * z - w * y) AS dx, 2 * (y * z + w * x) AS dy, 1 - 2 * (x * x + y * y) AS dz FROM u)"""


@query("e3_pose_stats", f"WITH {POSES}, {CAMERA}, m AS (SELECT scene, avg(dx) AS mx, avg(dy) AS my, avg(dz) AS mz FROM cam GROUP BY scene) SELECT scene, count(*) AS n_images, round(avg(sqrt(cx * cx + cy * cy + cz * cz)), 6) AS distance_mean, round(stddev_pop(sqrt(cx * cx + cy * cy + cz * cz)), 6) AS distance_std, round(avg(degrees(acos(greatest(-1, least(1, (dx * mx + dy * my + dz * mz) / (sqrt(mx * mx + my * my + mz * mz) * sqrt(dx * dx + dy * dy + dz * dz))))))), 6) AS angle_mean FROM cam JOIN m USING (scene) GROUP BY scene")
def e3(spark, sf):
    return rounded(de.pose_stats(poses(spark, sf)), [])


STAT = ", ".join(f"round({f}({c}), 6) AS {c}_{n}" for c in ("error", "track") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("median", "median")))


@query("e4_point_stats", f"WITH {POINTS}, g AS (SELECT scene, count(*) AS n_points, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez, {STAT} FROM pt GROUP BY scene) SELECT p_partkey AS scene, coalesce(n_points, 0) AS n_points, round(ex, 6) AS extent_x, round(ey, 6) AS extent_y, round(ez, 6) AS extent_z, error_mean, error_std, error_median, track_mean, track_std, track_median, round(greatest(ex, 1e-12) * greatest(ey, 1e-12) * greatest(ez, 1e-12), 4) AS volume, round(n_points / (greatest(ex, 1e-12) * greatest(ey, 1e-12) * greatest(ez, 1e-12)), 6) AS density FROM part LEFT JOIN g ON scene = p_partkey")
def e4(spark, sf):
    pts = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("scene"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("error"), F.col("l_linenumber").cast("double").alias("track"))
    d = de.point_stats(pts, load(spark, sf, "part").select(F.col("p_partkey").alias("scene")))
    return rounded(d.withColumn("volume", F.round("volume", 4)), ["volume"])


@query("e5_intrinsics", "SELECT p_partkey AS unit, round(CASE WHEN p_size % 3 = 0 THEN p_size * 10.0::DOUBLE ELSE 0.5::DOUBLE * p_retailprice / tan(0.5::DOUBLE * 1.2::DOUBLE) END, 6) AS fx, round(CASE WHEN p_size % 5 = 0 THEN p_size * 11.0::DOUBLE WHEN p_size % 3 = 0 THEN p_size * 10.0::DOUBLE ELSE 0.5::DOUBLE * p_retailprice / tan(0.5::DOUBLE * 1.2::DOUBLE) END, 6) AS fy FROM part")
def e5(spark, sf):
    p = load(spark, sf, "part")
    d = p.select(F.col("p_partkey").alias("unit"), F.col("p_retailprice").alias("w"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") * 10.0).alias("fl_x"), F.when(F.col("p_size") % 5 == 0, F.col("p_size") * 11.0).alias("fl_y"), F.lit(1.2).alias("angle_x"))
    return rounded(de.intrinsics(d).select("unit", "fx", "fy"), [])


@query("e6_image_entropy", "WITH h AS (SELECT l_suppkey AS scene, l_returnflag AS image, l_quantity AS level, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT scene, image, n::DOUBLE / sum(n) OVER (PARTITION BY scene, image) AS p FROM h), i AS (SELECT scene, image, -sum(p * log2(p)) AS entropy FROM p GROUP BY ALL) SELECT scene, round(avg(entropy), 6) AS entropy_mean, round(stddev_pop(entropy), 6) AS entropy_std FROM i GROUP BY scene")
def e6(spark, sf):
    h = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("scene"), F.col("l_returnflag").alias("image"), F.col("l_quantity").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(de.image_stats(de.image_entropy(h), ["entropy"]), [])


@query("e6_edge_share", """WITH p AS (SELECT label AS scene, vec_id AS image, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS level FROM embeddings), q AS (SELECT scene, image, i % 8 AS x, i // 8 AS y, level FROM p),
g AS (SELECT *, (coalesce(lead(level) OVER (PARTITION BY image, y ORDER BY x), level) - coalesce(lag(level) OVER (PARTITION BY image, y ORDER BY x), level)) / 2 AS gx, (coalesce(lead(level) OVER (PARTITION BY image, x ORDER BY y), level) - coalesce(lag(level) OVER (PARTITION BY image, x ORDER BY y), level)) / 2 AS gy FROM q),
m AS (SELECT *, round(sqrt(gx * gx + gy * gy), 9) AS g FROM g), a AS (SELECT *, round(avg(g) OVER (PARTITION BY image), 9) AS avg_g FROM m)
SELECT scene, image, avg((g > avg_g)::INT) AS edges, avg((level > 0)::INT) AS mask_share FROM a GROUP BY scene, image""")
def e6_edges(spark, sf):
    d = load(spark, sf, "embeddings").select(F.col("label").alias("scene"), F.col("vec_id").alias("image"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "level"))
    return de.edge_share(d.select("scene", "image", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), "level", (F.col("level") > 0).alias("mask")))


@query("e6_scene_image_stats", """WITH p AS (SELECT label AS scene, vec_id AS image, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS level FROM embeddings), q AS (SELECT scene, image, i % 8 AS x, i // 8 AS y, level FROM p),
g AS (SELECT *, (coalesce(lead(level) OVER (PARTITION BY image, y ORDER BY x), level) - coalesce(lag(level) OVER (PARTITION BY image, y ORDER BY x), level)) / 2 AS gx, (coalesce(lead(level) OVER (PARTITION BY image, x ORDER BY y), level) - coalesce(lag(level) OVER (PARTITION BY image, x ORDER BY y), level)) / 2 AS gy FROM q),
m AS (SELECT *, round(sqrt(gx * gx + gy * gy), 9) AS g FROM g), a AS (SELECT *, round(avg(g) OVER (PARTITION BY image), 9) AS avg_g FROM m),
ed AS (SELECT scene, image, avg((g > avg_g)::INT) AS edges, avg((level > 0)::INT) AS mask_share FROM a GROUP BY scene, image),
h AS (SELECT scene, image, round(level, 1) AS level, count(*) AS n FROM q GROUP BY ALL), hp AS (SELECT scene, image, n::DOUBLE / sum(n) OVER (PARTITION BY image) AS p FROM h), en AS (SELECT scene, image, -sum(p * log2(p)) AS entropy FROM hp GROUP BY ALL),
fr AS (SELECT label AS scene, vec_id AS image, CASE WHEN vec_id % 3 > 0 THEN abs(embedding[1])::DOUBLE END AS sharpness FROM embeddings)
SELECT scene, round(avg(entropy), 6) AS entropy_mean, round(stddev_pop(entropy), 6) AS entropy_std, round(avg(edges), 6) AS edges_mean, round(stddev_pop(edges), 6) AS edges_std, round(avg(mask_share), 6) AS mask_share_mean,
round(stddev_pop(mask_share), 6) AS mask_share_std, round(avg(sharpness), 6) AS sharpness_mean, round(stddev_pop(sharpness), 6) AS sharpness_std FROM ed JOIN en USING (scene, image) JOIN fr USING (scene, image) GROUP BY scene""")
def e6_scene(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("label").alias("scene"), F.col("vec_id").alias("image"), F.col("embedding").cast("array<double>").alias("v"))
    d = stored(e.select("scene", "image", F.posexplode("v").alias("i", "level")), "pixels")
    edges = de.edge_share(d.select("scene", "image", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), "level", (F.col("level") > 0).alias("mask")))
    entropy = de.image_entropy(d.groupBy("scene", "image", F.round("level", 1).alias("level")).agg(F.count(F.lit(1)).alias("n")))
    frames = e.select("scene", "image", F.when(F.col("image") % 3 > 0, F.abs(F.col("v")[0])).alias("sharpness"))
    return rounded(de.scene_image_stats(entropy, edges, frames), [])


FOCUS = """pr AS (SELECT a.scene, a.cx AS ax, a.cy AS ay, a.cz AS az, a.dx, a.dy, a.dz, b.dx AS ex, b.dy AS ey, b.dz AS ez, b.cx - a.cx AS ox, b.cy - a.cy AS oy, b.cz - a.cz AS oz,
  a.dy * b.dz - a.dz * b.dy AS kx, a.dz * b.dx - a.dx * b.dz AS ky, a.dx * b.dy - a.dy * b.dx AS kz FROM cam a JOIN cam b ON a.scene = b.scene AND a.image <> b.image),
pw AS (SELECT *, kx * kx + ky * ky + kz * kz AS w, (oy * ez - oz * ey) * kx + (oz * ex - ox * ez) * ky + (ox * ey - oy * ex) * kz AS s FROM pr),
fo AS (SELECT scene, sum((ax + s / w * dx) * w) / sum(w) AS fx, sum((ay + s / w * dy) * w) / sum(w) AS fy, sum((az + s / w * dz) * w) / sum(w) AS fz, sum(w) AS weight FROM pw WHERE w > 1e-5 GROUP BY scene)"""


def _focus(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = stored(de.camera(poses(spark, sf)).select("scene", "image", "cx", "cy", "cz", "dx", "dy", "dz"), "cameras")
    return c, de.focus_point(c)


@query("e7_focus_point", f"WITH {POSES}, {CAMERA}, {FOCUS} SELECT scene, round(fx, 6) + 0.0 AS fx, round(fy, 6) + 0.0 AS fy, round(fz, 6) + 0.0 AS fz, round(weight, 6) AS weight FROM fo")
def e7(spark, sf):
    return rounded(_focus(spark, sf)[1], [])


@query("e8_normalize_poses", f"WITH {POSES}, {CAMERA}, {FOCUS}, nn AS (SELECT scene, image, cx - fx AS nx, cy - fy AS ny, cz - fz AS nz FROM cam JOIN fo USING (scene)), sc_ AS (SELECT scene, 4 / avg(sqrt(nx * nx + ny * ny + nz * nz)) AS scale FROM nn GROUP BY scene) SELECT scene, image, round(nx * scale, 6) + 0.0 AS nx, round(ny * scale, 6) + 0.0 AS ny, round(nz * scale, 6) + 0.0 AS nz FROM nn JOIN sc_ USING (scene)")
def e8(spark, sf):
    return rounded(de.normalize_poses(*_focus(spark, sf)), [])


@query("e9_resolve_companion", "SELECT p_partkey AS unit, CASE WHEN p_size % 3 = 0 THEN 'masks/' || p_partkey || '.png' WHEN p_size % 2 = 0 THEN 'mask_' || p_partkey || '.png' END AS path FROM part")
def e9(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("unit"), "p_size")
    options = [F.concat(F.lit("masks/"), "unit", F.lit(".png")), F.concat(F.lit("mask_"), "unit", F.lit(".png"))]
    files = p.filter("p_size % 3 = 0").select(options[0].alias("path")).union(p.filter("p_size % 2 = 0").select(options[1].alias("path")))
    return de.resolve_companion(p, files, options).select("unit", "path")


# ---- M


@query("m1_check_reference", "WITH g AS (SELECT substr(p_brand, 7) AS brand, round(avg(p_size), 9) AS value FROM part GROUP BY 1), e AS (SELECT i::VARCHAR || j::VARCHAR AS brand, 25.0::DOUBLE AS expected FROM range(1, 7) a(i), range(1, 7) b(j)) SELECT brand, value, expected, coalesce(abs(value - expected) <= 1, false) AS ok FROM e LEFT JOIN g USING (brand)")
def m1(spark, sf):
    """Published means by brand; the list names brands that the table doesn't have."""
    got = load(spark, sf, "part").groupBy(F.substring("p_brand", 7, 9).alias("brand")).agg(F.round(F.avg("p_size"), 9).alias("value"))
    expected = spark.createDataFrame([(f"{i}{j}", 25.0, 1.0) for i in range(1, 7) for j in range(1, 7)], "brand string, expected double, tolerance double")
    return ck.check_reference(got, expected, ["brand"])


@query("m2_check_counts", "SELECT 'customer' AS name, count(*) AS n, 1500 AS expected, count(*) = 1500 AS ok FROM customer UNION ALL SELECT 'nation', count(*), 25, count(*) = 25 FROM nation UNION ALL SELECT 'lineitem', count(*), 60000, count(*) = 60000 FROM lineitem")
def m2(spark, sf):
    expected = {"customer": 1500, "nation": 25, "lineitem": 60000}
    return ck.check_counts({n: load(spark, sf, n) for n in expected}, expected)


@query("m3_scan_markers", "WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, (i + 1)::INT AS line, instr(s, 'token')::INT AS column FROM l WHERE contains(s, 'token')")
def m3(spark, sf):
    return ck.scan_markers(load(spark, sf, "documents"), "doc_id", "text", "token")


# ---- N


_LATEST = "WITH l AS (SELECT user_id AS unit, event_type AS method, max_by(value, event_id) AS value FROM events GROUP BY ALL)"


def _logs(spark, sf) -> DataFrame:
    return load(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("method"), F.col("event_id").alias("seq"), "value")


@query("n1_stream_logs", f"{_LATEST} SELECT method, count(DISTINCT unit) AS n_units, round(avg(value), 6) AS mean FROM l GROUP BY method")
def n1(spark, sf):
    path, mark = (scratch(spark, t) for t in ("arriving", "progress"))
    logs = _logs(spark, sf)
    logs.repartition(6).write.json(path)
    store = LatestStore(spark, scratch(spark, "store"), logs.schema)
    st.stream_logs(spark, path, logs.schema, store, mark, files_per_batch=2, merge_every=2).awaitTermination()
    return st.coverage_and_means(store.rows())


@query("n1_tiered_store", f"{_LATEST} SELECT method, count(DISTINCT unit) AS n_units, round(avg(value), 6) AS mean, 0 AS batches_left FROM l GROUP BY method")
def n1_store(spark, sf):
    """Two thirds of the logs are merged; then come the rest, the first ones again (late, so older rows don't win), and
    the last batch once more; all are merged."""
    logs = stored(_logs(spark, sf).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(3))), "logs")
    store = LatestStore(spark, scratch(spark, "store"), logs.drop("part").schema)
    for number, part in enumerate((0, 1)):
        store.add(logs.filter(F.col("part") == part), number)
    store.merge()
    for number, part in ((2, 2), (3, 0), (3, 0)):
        store.add(logs.filter(F.col("part") == part), number)
    store.merge()
    return st.coverage_and_means(store.rows()).withColumn("batches_left", F.lit(len(store.batches())))
