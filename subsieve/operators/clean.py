"""Columns, ids and gaps in tables put in order (B)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import to_double


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def canonicalize(df: DataFrame, spec: dict[str, list[str]], required: list[str], numeric: list[str] = ()) -> DataFrame:
    """One column for each name in spec: the first of its candidates that df has, by plain names; of columns with the
    same plain name the first counts. Optional ones that are missing are null; ValueError names missing required ones."""
    found: dict[str, str] = {}
    for c in df.columns:
        found.setdefault(plain_name(c), c)
    picked = {k: next((found[plain_name(c)] for c in names if plain_name(c) in found), None) for k, names in spec.items()}
    missing = [k for k in required if picked[k] is None]
    if missing:
        raise ValueError(f"no column for {missing} in {df.columns}")

    def column(k: str, c: str | None) -> Column:
        v = F.lit(None).cast("double" if k in numeric else "string") if c is None else F.col(f"`{c}`")
        return (to_double(v) if k in numeric else v).alias(k)

    return df.select(*[column(k, c) for k, c in picked.items()])


def extract_id(c: Column, pattern: str) -> Column:
    """The first group of the pattern, or the trimmed text where it doesn't match."""
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found != "", found).otherwise(F.trim(c))


def drop_incomplete(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Rows whose keys are neither null nor blank and whose metrics aren't null."""
    d = df.na.drop(subset=[*keys, *metrics])
    for k in keys:
        d = d.filter(F.trim(F.col(k).cast("string")) != "")
    return d


def collapse_mean(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).filter("_at = 1").drop("_at")


def stable_schema(df: DataFrame, prefix: list[str], canonical: list[str]) -> DataFrame:
    """The prefix, then all other columns by name; canonical ones that are missing are null numbers."""
    for c in canonical:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    return df.select(*prefix, *sorted(c for c in df.columns if c not in prefix))


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(means))  # one row
    return d.select(*[F.coalesce(F.col(c), F.col(f"_mean_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def column_stats(df: DataFrame, cols: list[str]) -> dict[str, dict[str, float]]:
    """Sample variance and share of non-null values of each column, in one pass; one row comes to the driver."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[x for c in cols for x in (F.var_samp(c).alias(f"v_{c}"), F.count(c).alias(f"c_{c}"))]).first()
    return {c: {"variance": r[f"v_{c}"], "share": r[f"c_{c}"] / r["n"] if r["n"] else 0.0} for c in cols}


def drop_constant(df: DataFrame, cols: list[str]) -> DataFrame:
    """Without the columns whose sample variance is 0, or that have no values."""
    gone = {c for c, s in column_stats(df, cols).items() if s["share"] == 0 or s["variance"] == 0}
    return df.select(*[c for c in df.columns if c not in gone])


def drop_sparse(df: DataFrame, cols: list[str], min_share: float) -> DataFrame:
    gone = {c for c, s in column_stats(df, cols).items() if s["share"] < min_share}
    return df.select(*[c for c in df.columns if c not in gone])
