"""A store of the latest row for each key, in two tiers.

Batches arrive in folders of their own number, dealt by a hash of the key; a batch that runs again replaces itself.
Merging folds them into one folder for each bucket of keys and rewrites only the buckets that they hit, so what is read
doesn't grow with the number of batches ever taken, and what is written doesn't grow with the store. A merge can be
repeated: the folders of batches go only after it, and rows that are already in the store change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..sources.tables import exists, remove


def latest(df: DataFrame, keys: tuple[str, ...] = ("unit", "method"), order: str = "seq") -> DataFrame:
    """The row with the largest `order` per key, ties by the other columns; an aggregate, so hot keys are summed early."""
    others = [c for c in df.columns if c not in (*keys, order)]
    d = df.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("x"))
    return d.select(*keys, "x.*")


class LatestStore:
    """The latest row per key of all batches, under `path`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...] = ("unit", "method"), order: str = "seq", buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, keys, order, buckets

    def add(self, batch: DataFrame, number: int) -> None:
        rows = latest(batch.select(*self.schema.names), self.keys, self.order)
        self._by_bucket(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/fresh/batch={number}")

    def batches(self) -> list[int]:
        """Numbers of the batches that aren't merged yet; a merge every few batches keeps them few."""
        if not exists(self.spark, f"{self.path}/fresh"):
            return []
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = fs.Path(f"{self.path}/fresh")
        names = [s.getPath().getName() for s in folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def merge(self) -> list[int]:
        """Folds the batches that are there now into the store; the buckets that were rewritten."""
        numbers = self.batches()
        if not numbers:
            return []
        fresh = self._fresh(numbers)
        hit = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most `buckets`
        both = self._merged().filter(F.col("bucket").isin(hit)).unionByName(fresh).drop("bucket")
        rows = self._by_bucket(latest(both, self.keys, self.order))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/merged")
        for n in numbers:
            remove(self.spark, f"{self.path}/fresh/batch={n}")
        return hit

    def rows(self) -> DataFrame:
        numbers = self.batches()
        d = self._merged()
        return latest((d.unionByName(self._fresh(numbers)) if numbers else d).drop("bucket"), self.keys, self.order)

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*self.schema.names).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets).cast("long")).cast("int"))
        return rows.repartition("bucket")

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema]).add("bucket", IntegerType())).parquet(path)

    def _merged(self) -> DataFrame:
        path = f"{self.path}/merged"
        return self._read(path) if exists(self.spark, path) else self.spark.createDataFrame([], StructType([*self.schema]).add("bucket", IntegerType()))

    def _fresh(self, numbers: list[int]) -> DataFrame:
        d = self._read(f"{self.path}/fresh/batch={numbers[0]}")
        for n in numbers[1:]:
            d = d.unionByName(self._read(f"{self.path}/fresh/batch={n}"))
        return d
