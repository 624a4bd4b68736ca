"""Connected components of a link table, by star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): the smallest node that each can reach; nodes without links aren't in it.

    In turn, each node ties its larger neighbours to its smallest one, then its smaller ones and itself, until the table
    stays as it is. Minima are aggregates, so no node's neighbours are gathered; each round is written to shared files.
    """
    now, was = stored(_down(links), "links"), None
    while was != (state := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())):
        was = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = _down(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        now = stored(_down(small), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
