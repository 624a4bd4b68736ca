"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load as table
from ..sources.tables import scratch, shared_dir, temporary
from ..sources.tables import stored as materialize

__all__ = ["BATCH_BYTES", "WORD", "fresh", "lowest", "materialize", "scratch", "shared_dir", "small_batches", "table", "temporary", "text_or_empty"]

#: White space that parts words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow's batches hold BATCH_BYTES at most, as whole texts go through them; what the session sets itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, so that extra columns can't clash."""
    have, out = {c.lower() for c in df.columns}, name
    while out.lower() in have:
        out = f"_{out}"
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lowest(keys: DataFrame, n: int) -> DataFrame:
    """The n different rows of `keys` whose hash is lowest (all, if they are fewer).

    An estimate of how many there are gives a bound for the hash that about 4 n rows meet, so a task sends few rows,
    however many tasks there are.
    """
    h = F.shiftrightunsigned(F.xxhash64(*keys.columns), 1)
    about = keys.agg(F.approx_count_distinct(F.xxhash64(*keys.columns), 0.02)).first()[0]
    some = keys.filter(h <= int(min(1.0, 4 * n / max(1, about)) * (2**63 - 1))) if about > 4 * n else keys
    return some.distinct().orderBy(h, *keys.columns).limit(n)
