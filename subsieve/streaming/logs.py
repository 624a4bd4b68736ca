"""New logs taken in as they arrive (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .store import LatestStore


def stream_logs(spark: SparkSession, path: str, schema: StructType, store: LatestStore, checkpoint: str, files_per_batch: int = 100, merge_every: int = 20) -> StreamingQuery:
    """Take in the JSON logs that are in `path` now: each batch adds its latest row per key to `store`, and every so many
    batches are merged.

    A batch that runs again after a failure replaces itself, or, if it was merged, changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.add(batch, number)
        if number % merge_every == merge_every - 1:
            store.merge()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_and_means(logs: DataFrame) -> DataFrame:
    return logs.groupBy("method").agg(F.count_distinct("unit").alias("n_units"), F.round(F.avg("value"), 6).alias("mean"))
