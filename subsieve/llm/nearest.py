"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut into two halves, each quantised by its own k-means centroids; a pair of centroids is a cell. A query
goes through the cells by growing sum of its distances to the two centroids (a heap over the sorted pairs), until the
cells visited hold a given share of all vectors, and one more than the neighbours asked for (all, if they are fewer);
what is in them is ranked by exact distance.

Equal vectors are indexed once, with the few smallest ids that a result could need, so copies don't fill a cell.
Ranking is done in blocks, at most BLOCK queries against BLOCK vectors a task, which return each query's best only.
"""

from __future__ import annotations

import heapq
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lowest, materialize, table

SAMPLE = 20_000  # vectors that the centroids are fitted on, at most
VISIT = 0.7  # share of the vectors that the visited cells hold at least
BLOCK = 4096
SEED = 11


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: vector not null, not zero, all components finite, with an
    id, and of the length that most vectors have (of equally common lengths the smaller)."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    v = v.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)")
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
    return v.filter(F.size("v") == (sizes["n"] if sizes else 0))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _distances(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)


def fit(groups: DataFrame, k: int, sample: int = SAMPLE) -> list[np.ndarray]:
    """Centroids of both halves, from the `sample` vectors whose ids hash lowest."""
    ids = lowest(groups.select("vid"), sample)
    rows = groups.join(F.broadcast(ids), "vid").orderBy("vid").select("v").toPandas()  # `sample` rows
    x = np.array(rows["v"].tolist(), dtype=np.float64)
    h = x.shape[1] // 2
    return [kmeans(x[:, :h], k, SEED), kmeans(x[:, h:], k, SEED + 1)]


def with_cells(groups: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    def run(batches):
        for b in batches:
            x = np.array(b.column("v").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            h = x.shape[1] // 2
            cell = _distances(x[:, :h], centroids[0]).argmin(1) * len(centroids[1]) + _distances(x[:, h:], centroids[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    return groups.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema) + ", cell int")


def traverse(q: np.ndarray, centroids: list[np.ndarray], counts: np.ndarray, enough: float) -> np.ndarray:
    """A flag for each cell that the query visits."""
    h = len(q) // 2
    near = [((c - part) ** 2).sum(1) for c, part in zip(centroids, (q[:h], q[h:]), strict=True)]
    order = [d.argsort(kind="stable") for d in near]
    a, b = (d[o].tolist() for d, o in zip(near, order, strict=True))
    seen, found = np.zeros(len(counts), bool), 0
    heap, reached = [(a[0] + b[0], 0, 0)], [0] * len(a)  # reached[i]: pairs (i, j) with smaller j are done
    while heap and found < enough:
        _, i, j = heapq.heappop(heap)
        cell = order[0][i] * len(b) + order[1][j]
        seen[cell], found, reached[i] = True, found + counts[cell], j + 1
        for x, y in ((i + 1, j), (i, j + 1)):  # a pair is next once both its lower neighbours are done
            if x < len(a) and y < len(b) and reached[x] == y and (x == 0 or reached[x - 1] > y):
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return seen


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(((x - q) ** 2).sum(1))
    if len(d) > k:
        keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        d, ids = d[keep], ids[keep]
    first = np.lexsort((ids, d))[:k]
    return ids[first], d[first]


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, visit: float = VISIT) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by `every`.

    Candidates are all usable rows but those with the query's own vec_id; fewer than k candidates: all of them. Ties go
    to the smaller vec_id. Repeated rows (same id and vector) count once. No usable rows: no rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = materialize(usable(vectors), "vectors")
    first = v.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    groups = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vid", F.col("ids")[0])
    groups = materialize(groups, "groups")
    n = groups.count()
    if not n:
        return empty
    width = groups.select(F.size("v")).first()[0]
    if width < 2:  # no halves: every component gets a zero beside it
        groups, v = (d.withColumn("v", F.concat("v", F.array(F.lit(0.0)))) for d in (groups, v))
    centroids = fit(groups, min(256, max(16, ceil(sqrt(n / 4)))))
    indexed = materialize(with_cells(groups.select("vid", "v"), centroids), "index")
    counts = np.zeros(len(centroids[0]) * len(centroids[1]), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # 256 x 256 cells at most
        counts[r["cell"]] = r["count"]
    # shards of BLOCK vectors in order of cells, so that a query goes to those only that hold cells it visits
    ends = counts.cumsum()
    place = spark.createDataFrame([(c, int(ends[c] - counts[c]), int(counts[c])) for c in np.flatnonzero(counts).tolist()], "cell int, start long, held long")
    at = F.col("start") + F.pmod(F.xxhash64("vid"), "held")
    indexed = indexed.join(F.broadcast(place), "cell").select("vid", "v", "cell", F.floor(at / BLOCK).alias("shard"))  # 256 x 256 rows at most

    asked = v.filter(F.col("vec_id") % every == 0).join(groups.select("v", "vid"), "v").select("vec_id", "vid").distinct()
    asked = materialize(asked, "asked")
    sides = max(1, ceil(asked.select("vid").distinct().count() / BLOCK))

    enough = max(visit * n, min(n, k + 1))

    def visits(batches):
        """A row for each query and shard, with the visited cells that the shard holds some of."""
        for b in batches:
            x = np.array(b.column("v").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            for i, q in enumerate(x):
                cells = np.flatnonzero(traverse(q, centroids, counts, enough) & (counts > 0))
                first, last = (ends - counts)[cells] // BLOCK, (ends[cells] - 1) // BLOCK
                held = last - first + 1
                shard = np.repeat(first, held) + np.arange(held.sum()) - np.repeat(held.cumsum() - held, held)
                begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))  # cells are in order of their places, and so are shards
                lists = [c.astype("<i4").tobytes() for c in np.split(np.repeat(cells, held), begin[1:])]
                row = b.slice(i, 1).take(pa.array(np.zeros(len(begin), int)))
                yield pa.RecordBatch.from_arrays([row.column("vid"), row.column("v"), pa.array(shard[begin], pa.int64()), pa.array(lists, pa.binary())], ["vid", "v", "shard", "visited"])

    queries = indexed.select("vid", "v").join(asked.select("vid").distinct(), "vid", "left_semi")
    left = queries.repartition(spark.sparkContext.defaultParallelism).mapInArrow(visits, "vid long, v array<double>, shard long, visited binary")
    left = left.withColumn("side", F.pmod(F.xxhash64("vid"), F.lit(sides).cast("long")))
    right = indexed.withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))))

    def rank(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            xs, ids, cells = np.array(x["v"].tolist()), x["vid"].to_numpy(), x["cell"].to_numpy()
            for vid, vec, visited in zip(q["vid"], q["v"], q["visited"], strict=True):
                at = np.isin(cells, np.frombuffer(visited, "<i4"))
                found, d = best(np.asarray(vec), xs[at], ids[at], k + 1)
                out.append(pd.DataFrame({"qid": vid, "vid": found, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "vid": [], "score": []})

    found = left.groupBy("shard", "side").cogroup(right.groupBy("shard", "side")).applyInPandas(rank, "qid long, vid long, score double")
    top = Window.partitionBy("qid").orderBy("score", "vid")
    found = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).join(groups.select("vid", "ids"), "vid")
    found = found.groupBy("qid").agg(F.sort_array(F.flatten(F.collect_list(F.expr("transform(ids, i -> struct(score, i as vec_id))")))).alias("found"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qid")).join(found, "qid")
    own = own.select("query_id", F.posexplode(F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {k})")).alias("rank", "x"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
