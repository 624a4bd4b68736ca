"""Queries over folders of files that are written first: a folder for each supplier, with some files missing or broken (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import listing as ls
from ..sources.tables import load, scratch, stored

QUERIES: dict = {}
SQL: dict = {}
PATTERN = r"/unit=([^/]+)/asset=([^/]+)/"
REQUIRED = [("frames", ["frames"]), ("points", ["points"]), ("masks", ["masks", "alpha"])]
VERSION = 2


def query(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return put


def _written(spark, sf) -> str:
    """A folder of the files of all suppliers: unit=<key>/asset=<name>/part-0.txt."""
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("x"))
    frames = F.when(F.col("unit") % 13 == 0, "{not json").otherwise(F.to_json(F.struct("name", "x")))
    made = [("frames", frames, F.col("unit") % 11 != 0), ("points", F.col("name"), F.col("unit") % 7 != 0), ("masks", F.lit("m"), F.col("unit") % 3 == 0), ("alpha", F.lit("a"), F.col("unit") % 3 == 1)]
    files = F.filter(F.array(*[F.struct(F.lit(n).alias("asset"), text.alias("text"), there.alias("there")) for n, text, there in made]), lambda f: f["there"])
    path = scratch(spark, "files")
    ls.write_files(s.repartition(spark.sparkContext.defaultParallelism).select("unit", F.explode(files).alias("f")).select(_place("unit", "f.asset"), "f.text"), path)
    return path


def _place(unit: str, asset: str):
    return F.format_string("unit=%s/asset=%s/part-0.txt", F.col(unit).cast("string"), F.col(asset)).alias("path")


def _checked(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """(units with error codes, the frames file of each)."""
    files = stored(ls.unit_files(ls.list_files(spark, root, "part-*"), PATTERN), "files")
    units = ls.first_missing(files.select("unit"), files, REQUIRED)
    frames = files.filter("asset = 'frames'").select("unit", "path", "modified")
    broken = frames.join(ls.invalid_json(ls.texts_of(frames, root)), "path", "left_semi").select("unit", F.lit("invalid_frames").alias("broken"))
    units = units.join(broken, "unit", "left").select("unit", F.coalesce("broken", "error_code").alias("error_code"))
    return stored(units, "units"), frames


_UNITS = """
WITH s AS (SELECT s_suppkey AS unit FROM supplier),
u AS (SELECT unit, CASE WHEN unit % 13 = 0 AND unit % 11 <> 0 THEN 'invalid_frames' WHEN unit % 11 = 0 THEN 'missing_frames' WHEN unit % 7 = 0 THEN 'missing_points' WHEN unit % 3 = 2 THEN 'missing_masks' END AS error_code FROM s
      WHERE unit % 11 <> 0 OR unit % 7 <> 0 OR unit % 3 <> 2)"""


@query("a10_file_assets", f"{_UNITS} SELECT unit::VARCHAR AS unit, error_code FROM u")
def a10_files(spark, sf):
    """The first file that each unit lacks, or whose content isn't what it should be, from a listing of real folders."""
    return _checked(spark, _written(spark, sf))[0]


_RUNS = " UNION ALL ".join(f"SELECT '{run}' AS run, {hits} AS hits, {left} AS work_left, bad AS failed, first_bad FROM n" for run, hits, left in (("first", "0", "good"), ("again", "good", "0"), ("one changed", "greatest(0, good - 1)", "least(1, good)"), ("other parameters", "0", "good"), ("other version", "0", "good")))


@query("a9_file_listing", f"{_UNITS}, n AS (SELECT count(*) FILTER (error_code IS NULL) AS good, count(*) FILTER (error_code IS NOT NULL) AS bad, min(lpad(unit::VARCHAR, 12, '0') || ' ' || error_code) AS first_bad FROM u) {_RUNS}")
def a9_files(spark, sf):
    """Five runs over the same folders: what the cache holds, what is left to do, and the first unit that can't be done."""
    root, cache = _written(spark, sf), scratch(spark, "cache")
    out = []
    for run, params, version in (("first", "stride=1", VERSION), ("again", "stride=1", VERSION), ("one changed", "stride=1", VERSION), ("other parameters", "stride=2", VERSION), ("other version", "stride=1", VERSION + 1)):
        if run == "one changed":
            one = units.filter("error_code is null").agg(F.min(F.col("unit").cast("long")).alias("unit"))
            one = one.filter("unit is not null").select("unit", F.lit("frames").alias("asset"), F.lit('{"name": "changed"}').alias("text"))
            ls.write_files(one.select(_place("unit", "asset"), "text"), root)
        units, frames = _checked(spark, root)
        good = frames.join(units.filter("error_code is null"), "unit", "left_semi")
        hits, left = (stored(d, "work") for d in ls.plan_work(good, ls.load_cache(spark, cache, "unit string, n int", version), params, version))
        if version == VERSION:
            ls.keep(left.select(*ls.KEYS, "unit", F.lit(1).alias("n")), cache, version)
        bad = units.filter("error_code is not null").agg(F.count(F.lit(1)).alias("failed"), F.min(F.concat(F.lpad("unit", 12, "0"), F.lit(" "), F.col("error_code"))).alias("first_bad"))
        counts = hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(left.agg(F.count(F.lit(1)).alias("work_left"))).crossJoin(bad)
        out.append(stored(counts.select(F.lit(run).alias("run"), "hits", "work_left", "failed", "first_bad"), "run"))
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])
