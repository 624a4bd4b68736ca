"""Readers and writers for metric tables, JSON logs, free text, manifests and result stores (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import to_double

LOG = T.StructType([T.StructField("unit", T.StringType()), T.StructField("method", T.StringType()), T.StructField("results", T.StructType([T.StructField("value", T.DoubleType()), T.StructField("count", T.DoubleType())]))])


def read_metrics(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_logs(spark: SparkSession, path: str, schema: T.StructType = LOG, expected: DataFrame | None = None, multi_line: bool = False) -> DataFrame:
    """unit, method, value, count of JSON logs; a log without a unit goes by its file's name.

    Lenient: logs that can't be read or have no value are left out. Strict (expected units given): ValueError if one of
    them is missing, with the number of those.
    """
    d = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multi_line).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    d = d.select(F.coalesce("unit", stem).alias("unit"), "method", to_double("results.value").alias("value"), to_double("results.count").alias("count")).filter("value is not null")
    if expected is not None:
        missing = expected.select("unit").join(d.select("unit"), "unit", "left_anti").count()
        if missing:
            raise ValueError(f"{missing} units have no log")
    return d


def overlay(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows whose key no earlier source has; within a source keys should be distinct."""
    d = None
    for i, s in enumerate(sources):
        s = s.withColumn("_priority", F.lit(i))
        d = s if d is None else d.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_priority")
    return d.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at", "_priority")


def pick(json: Column, paths: list[str]) -> Column:
    """The first path of a JSON text that holds a number."""
    return F.coalesce(*[to_double(F.get_json_object(json, p)) for p in paths])


def list_stats(values: Column, name: str) -> list[Column]:
    """Mean, variance (ddof 0), least, largest and number of an array of numbers."""
    n = F.size(values)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(values) / n
    some = lambda c: F.when(n > 0, c)
    var = total(F.transform(values, lambda x: (x - mean) * (x - mean))) / n
    return [some(mean).alias(f"{name}_mean"), some(var).alias(f"{name}_var"), F.array_min(values).alias(f"{name}_min"), F.array_max(values).alias(f"{name}_max"), F.when(values.isNotNull(), n).alias(f"{name}_n")]


def flatten_features(df: DataFrame, key: str, json: str, spec: dict[str, list[str]], lists: dict[str, str] = ()) -> DataFrame:
    """key, then a number for each name in spec (alternate JSON paths), and statistics of each list field."""
    stats = [c for name, path in dict(lists).items() for c in list_stats(F.filter(F.from_json(F.get_json_object(json, path), "array<double>"), lambda x: x.isNotNull()), name)]
    return df.select(key, *[pick(F.col(json), paths).alias(name) for name, paths in spec.items()], *stats)


def flatten_numbers(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with every number in the nested struct column as its own column; names joined by '_'. The schema is walked, not the rows."""

    def walk(t: T.DataType, at: Column, name: str) -> list[Column]:
        if isinstance(t, T.StructType):
            return [c for f in t for c in walk(f.dataType, at[f.name], f"{name}_{f.name}" if name else f.name)]
        return [at.cast("double").alias(name)] if isinstance(t, T.NumericType) else []

    return df.select(key, *walk(df.schema[value].dataType, F.col(value), ""))


def scrape_records(df: DataFrame, key: str, text: str, marker: str, terminator: str, separator: str, min_fields: int) -> DataFrame:
    """key, line, fields: lines with the marker, what follows it up to the terminator, split; those with enough fields."""
    d = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "s")).filter(F.col("s").contains(marker))
    cut = F.substring_index(F.substring(F.col("s"), F.locate(marker, F.col("s")) + len(marker), F.length("s")), terminator, 1)
    d = d.withColumn("fields", F.transform(F.split(cut, separator), lambda x: F.trim(x)))
    return d.filter(F.size("fields") >= min_fields).select(key, "line", "fields")


def read_manifest(df: DataFrame, column: str) -> DataFrame:
    """Trimmed, different, non-empty ids."""
    return df.select(F.trim(F.col(column).cast("string")).alias("unit")).filter("unit <> ''").distinct()


def write_manifests(df: DataFrame, path: str, by: str | list[str] = "b") -> None:
    """A folder for each budget (and what else is in `by`), rows in order of unit."""
    by = [by] if isinstance(by, str) else by
    df.repartition(*by).sortWithinPartitions(*by, "unit").write.partitionBy(*by).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, order: list[str], fmt: str = "csv") -> None:
    """A table of results (a frontier, trials, an audit's findings) as CSV with a header or JSON lines, its rows in `order`
    over all part files, taken by name; nulls are written too."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if fmt == "json":
        d.write.option("ignoreNullFields", False).json(path)
    else:
        d.write.option("header", True).csv(path)


def upsert(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with new rows in place of those with the same key."""
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def split_cached(df: DataFrame, cache: DataFrame, keys: list[str], version: int) -> tuple[DataFrame, DataFrame]:
    """(cached results, rows to do) by keys; entries of another version don't count."""
    known = cache.filter(F.col("version") == version)
    return known.join(df.select(*keys), keys, "left_semi"), df.join(known.select(*keys), keys, "left_anti")


def check_assets(units: DataFrame, assets: DataFrame, required: list[str]) -> DataFrame:
    """unit, n_assets, error_code: 'missing_<first required asset that isn't there>' or null."""
    have = assets.groupBy("unit").agg(F.collect_set("asset").alias("have"))
    d = units.select("unit").join(have, "unit", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    lacks = F.array_except(F.array(*[F.lit(r) for r in required]), F.col("have"))
    return d.select("unit", F.size("have").alias("n_assets"), F.when(F.size(lacks) > 0, F.concat(F.lit("missing_"), lacks[0])).alias("error_code"))
