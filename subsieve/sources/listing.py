"""Files by name and time: listing, whole texts, completeness of a unit's files, and work that earlier runs left to do.

A listing reads names, times and sizes only; the content of files stays where it is until a text is asked for. What was
worked out of a file is kept under its path, its time and the parameters, so a file that changed is work again, and so is
every file when the parameters or the version of the work change.
"""

from __future__ import annotations

import fnmatch

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import union_all
from .files import split_cached
from .tables import exists, stored

KEYS = ["path", "modified", "params"]


def write_files(files: DataFrame, root: str) -> int:
    """Writes each of files (path below root, text), a file that is there anew, and returns how many.

    Tasks write files where they belong, through pyarrow.fs, so root must be a folder that it opens (file, hdfs, s3, gs).
    Spark's writer makes a temporary file for each folder, and the driver moves these one by one.
    """

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for path, text in zip(*(b.column(c).to_pylist() for c in ("path", "text")), strict=True):
                fs.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(f"{'' if text is None else text}\n".encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    fs, base = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    return files.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, folder, file, modified, size of all files below root whose name matches; no content is read.

    A job for each level of folders: tasks list the folders of the level before, through pyarrow.fs, so neither the driver
    nor a task gets them all, however many there are. As in Spark, names that begin with a dot or an underscore are left
    out (but for an underscore before a partition's equals sign).
    """
    root = root.rstrip("/")

    def entries(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for at in b.column("path").to_pylist():
                found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(base + at)) if not f.base_name.startswith(".") and not (f.base_name.startswith("_") and "=" not in f.base_name)]
                yield pa.RecordBatch.from_arrays([pa.array([f"{at}/{f.base_name}" for f in found], pa.string()), pa.array([f.base_name for f in found], pa.string()),
                    pa.array([f.type == pyarrow.fs.FileType.Directory for f in found], pa.bool_()), pa.array([(f.mtime_ns or 0) // 1000 for f in found], pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array([f.size for f in found], pa.int64())],
                    ["path", "file", "is_folder", "modified", "size"])

    n, folders, levels = spark.sparkContext.defaultParallelism, spark.createDataFrame([("",)], "path string").coalesce(1), []
    while not levels or not folders.isEmpty():
        levels.append(stored(folders.mapInArrow(entries, "path string, file string, is_folder boolean, modified timestamp, size long"), "level"))
        folders = levels[-1].filter("is_folder").select("path").repartition(n, "path")
    like = F.col("file").rlike(f"^{fnmatch.translate(glob)}")
    d = union_all(levels).filter(~F.col("is_folder") & like).withColumn("path", F.concat(F.lit(root), "path"))
    return d.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "file", "modified", "size")


def texts_of(files: DataFrame, root: str) -> DataFrame:
    """path, text of files (path) that list_files found below root, a row for each; read by tasks, each file whole."""
    root = root.rstrip("/")

    def read(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for path in b.column("path").to_pylist():
                with fs.open_input_stream(base + path[len(root) :]) as f:
                    yield pa.RecordBatch.from_pydict({"path": [path], "text": [f.read().decode(errors="replace")]}, schema=pa.schema([("path", pa.string()), ("text", pa.string())]))

    return files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(read, "path string, text string")


def read_whole(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, modified, text of all files below root whose name matches, a row for each file."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def unit_files(files: DataFrame, pattern: str) -> DataFrame:
    """unit, asset, path, modified: of the paths that match pattern, whose two groups are the unit and the asset."""
    d = files.withColumn("unit", F.regexp_extract("path", pattern, 1)).withColumn("asset", F.regexp_extract("path", pattern, 2))
    return d.filter("unit <> '' and asset <> ''").select("unit", "asset", "path", "modified")


def first_missing(units: DataFrame, assets: DataFrame, required: list[tuple[str, list[str]]]) -> DataFrame:
    """unit, error_code of each of units: 'missing_<name>' of the first required asset none of whose alternatives the unit
    has in assets (unit, asset), or null; required is a list of (name, alternatives)."""
    known = [a for _, some in required for a in some]
    have = assets.filter(F.col("asset").isin(known)).groupBy("unit").agg(F.collect_set("asset").alias("have"))  # known ones at most
    d = units.select("unit").distinct().join(have, "unit", "left")
    code = F.lit(None).cast("string")
    for name, some in reversed(required):
        code = F.when(F.coalesce(F.arrays_overlap("have", F.array(*[F.lit(a) for a in some])), F.lit(False)), code).otherwise(f"missing_{name}")
    return d.select("unit", code.alias("error_code"))


def invalid_json(texts: DataFrame) -> DataFrame:
    """path of the texts (path, text) that aren't a JSON object."""
    parsed = F.try_parse_json("text")
    return texts.filter(F.coalesce(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(True))).select("path")


def load_cache(spark: SparkSession, path: str, results: str, version: int) -> DataFrame:
    """path, modified, params, version and the result columns (a schema string) of the entries of this version; none if
    nothing was ever kept at `path`."""
    schema = f"path string, modified timestamp, params string, version int, {results}"
    d = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return d.filter(F.col("version") == version).dropDuplicates(KEYS)


def plan_work(files: DataFrame, cache: DataFrame, params: str, version: int) -> tuple[DataFrame, DataFrame]:
    """(hits, work left) of files (path, modified, others): entries of the cache, and files without one."""
    return split_cached(files.withColumn("params", F.lit(params)), cache, KEYS, version)


def keep(done: DataFrame, path: str, version: int) -> None:
    """Adds results (path, modified, params, result columns) to the cache at `path`."""
    done.withColumn("version", F.lit(version)).write.mode("append").parquet(path)
