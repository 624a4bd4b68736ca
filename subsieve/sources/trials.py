"""A store of drawn trials, so that later audits of the same population neither draw nor rank nor shuffle again.

An entry is keyed by everything that its rows follow from: the seed, the number of trials, the allocation (budgets and
what they take of each regime) and the scores, the latter two by fingerprints that don't depend on the order of rows.
Another input, or one that has changed, has another key. An entry holds three tables: draws and ranked scores, bucketed
by unit, so that they and other tables of units that are bucketed alike meet without a shuffle, and the trial table, one
row for each trial, method and metric, which answers every event. A marker is written after all three, so what a lost
driver left half done is written again, under another folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fidelity as fi
from ..operators import sampling as sa
from .tables import exists, remove

VERSION = 1  # of how draws, ranks and trial statistics are worked out; entries of another one aren't found


def fingerprint(df: DataFrame) -> str:
    """Of the columns, by name and type, and rows of a table, whatever their order; one scan, nothing is shuffled but sums.

    Two independent 64-bit hashes of each row are added up as decimals, so repeated rows count.
    """
    cols = sorted(df.columns)
    h = [F.sum(f(*cols).cast("decimal(38,0)")) for f in (F.xxhash64, lambda *c: F.xxhash64(F.lit("second"), *c))]
    return hashlib.sha256(json.dumps([sorted(df.dtypes), *map(str, df.agg(F.count(F.lit(1)), *h).first())]).encode()).hexdigest()


@dataclass(frozen=True)
class Trials:
    """What the store holds of one audit; `hit` is true if it was there."""

    key: str
    hit: bool
    draws: DataFrame  # b, trial, unit, regime and the other columns of the allocation
    ranked: DataFrame  # scores with f_le and f_lt, the population's shares at most and below, and pop_mean
    trials: DataFrame  # keys, method, metric, n, mean, pop_mean, gap, ks


class TrialStore:
    """Entries under `path`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def key(self, scores: DataFrame, alloc: DataFrame, trials: int, seed: int) -> str:
        said = [VERSION, trials, seed, self.buckets, fingerprint(alloc), fingerprint(scores)]
        return hashlib.sha256(json.dumps(said).encode()).hexdigest()[:32]

    def get(self, scores: DataFrame, alloc: DataFrame, trials: int, seed: int) -> Trials:
        """The trials of alloc (b, regime, take) over scores (unit, regime, method, metric, value): read, or else drawn,
        written and read."""
        key = self.key(scores, alloc, trials, seed)
        found = self._found(key)
        if not found:
            self._write(key, scores, alloc, trials, seed)
        return Trials(key, bool(found), *self._tables(key, found or self._found(key)))

    def forget(self, key: str) -> None:
        remove(self.spark, f"{self.path}/{key}")

    def _found(self, key: str) -> str | None:
        """The folder of a whole entry; of several, which drivers wrote at once, the first by name."""
        marker = f"{self.path}/{key}/whole"
        if not exists(self.spark, marker):
            return None
        return self.spark.read.text(marker).agg(F.min("value")).first()[0]

    def _write(self, key: str, scores: DataFrame, alloc: DataFrame, trials: int, seed: int) -> None:
        part = f"{self.path}/{key}/{uuid.uuid4().hex}"
        pop = scores.select("unit", "regime").distinct()
        self._bucketed(sa.draw_allocated(pop, alloc, trials, seed), f"{part}/draws")
        means = scores.groupBy(*fi.KEY).agg(F.avg("value").alias("pop_mean"))
        self._bucketed(fi.ranked(scores).join(means, fi.KEY), f"{part}/ranked")
        draws, ranked = (self._table(f"{key[:8]}_{n}", f"{part}/{n}") for n in ("draws", "ranked"))
        extra = [c for c in draws.columns if c not in ("unit", "regime")]
        fi.drawn_stats(draws.select(*extra, "unit").join(ranked.drop("regime"), "unit"), fi.KEY, extra).write.parquet(f"{part}/trials")
        self.spark.createDataFrame([(part,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/{key}/whole")

    def _bucketed(self, df: DataFrame, path: str) -> None:
        name = f"written_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "unit").write.bucketBy(self.buckets, "unit").sortBy("unit").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay, as the table has a path of its own

    def _table(self, name: str, path: str) -> DataFrame:
        """The bucketed files of a folder as a table of this session's catalog, so that Spark knows their buckets."""
        name = f"trials_{name}_{hashlib.sha256(path.encode()).hexdigest()[:8]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (unit) SORTED BY (unit) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _tables(self, key: str, part: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        draws, ranked = (self._table(f"{key[:8]}_{n}", f"{part}/{n}") for n in ("draws", "ranked"))
        return draws, ranked, self.spark.read.parquet(f"{part}/trials")
