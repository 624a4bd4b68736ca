"""Validation of published tables (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_reference(got: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, expected, ok: equal, or within the expected row's tolerance; rows that are missing aren't ok."""
    d = expected.join(got, keys, "left")
    near = F.when(F.col("tolerance").isNull(), F.col("value") == F.col("expected")).otherwise(F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"))
    return d.select(*keys, "value", "expected", F.coalesce(near, F.lit(False)).alias("ok"))


def check_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """name, n, expected, ok for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(expected[name]).cast("long").alias("expected"))
        out = one if out is None else out.union(one)
    return out.withColumn("ok", F.col("n") == F.col("expected"))


def scan_markers(df: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """key, line, column (both from 1) of each line's first marker."""
    d = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "s")).filter(F.col("s").contains(marker))
    return d.select(key, (F.col("at") + 1).alias("line"), F.locate(marker, F.col("s")).alias("column"))
