"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a fixed shuffled order. A document's virtual finish time is the words of
its source up to and with it, divided by the source's target. All queues are served in order of that time, so at any
moment every source has had the same share of its target; at time 1 the total budget is spent, and the document that
a source is then at is cut there. A source whose target is above its size starts over, up to `max_repeat` times.

Running sums over a source never put a whole source in one task: the shuffled order is cut into hash buckets, sums by
(source, bucket) are small, and only a bucket is sorted by one task.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (5, 2, 1)
SEED = 7
ROWS_PER_BUCKET = 500
MAX_BUCKETS = 65536  # the first four hex digits of the shuffle hash


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """Per source key: its target.

    `totals` has (k, source_size), a row for each source; k orders the sources. The weights repeat over the sources in
    order. The budget is `share` of all sizes. No target exceeds max_repeat x source_size; what is above goes to the
    others by weight until none is above: sources in order of cap/weight are capped as long as their cap is below what
    the others' level would give them. All windows here run over one row for each source.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy("level", "k")
    w = F.array(*[F.lit(float(x)) for x in weights])
    d = totals.withColumn("place", F.row_number().over(Window.orderBy("k")) - 1)
    d = d.withColumn("weight", w[F.col("place") % len(weights)])
    d = d.withColumn("cap", max_repeat * F.col("source_size").cast("double"))
    d = d.withColumn("level", F.col("cap") / F.col("weight"))
    d = d.withColumn("budget", share * F.sum("source_size").over(everything).cast("double"))
    d = d.withColumn("capped_before", F.sum("cap").over(by_level) - F.col("cap"))
    d = d.withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("share_level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    d = d.withColumn("open", F.col("level") > F.col("share_level"))
    all_by_level = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("fill", F.first(F.when(F.col("open"), F.col("share_level")), ignorenulls=True).over(all_by_level))
    d = d.withColumn("target", F.when(F.col("open"), F.col("fill") * F.col("weight")).otherwise(F.col("cap")))
    return d.select("k", "source_size", "target")


def mixing_plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_repeat: int = 3, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Each document with size, source_size, target, start (words of its source before it), finish and taken.

    `docs` has doc_id, text and source; its columns, or those in `carry` only, come back in the struct column `doc`; what
    isn't carried isn't shuffled. Null text: size 0.
    Null source: one more source, last in order. Null doc_id: shuffled by the text alone. Repeated rows: each counts.
    Documents without words take nothing. Empty table: no rows. The order depends on the rows and the seed only.
    """
    n = docs.count()
    buckets = max(1, min(MAX_BUCKETS, ceil(n / ROWS_PER_BUCKET)))
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("doc"),
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("k"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")))).alias("h"),
    )
    d = d if carry is None else materialize(d, "sizes")
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * buckets / MAX_BUCKETS))
    sums = materialize(d.groupBy("k", "bucket").agg(F.sum("size").alias("bucket_size")), "sums")
    goals = targets(sums.groupBy("k").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_repeat)
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("offset", F.sum("bucket_size").over(before) - F.col("bucket_size")).drop("bucket_size").join(goals, "k")
    inside = Window.partitionBy("k", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(inside)).join(sums, ["k", "bucket"])
    d = d.withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
    d = d.withColumn("finish", (F.col("start") + F.col("size")) / F.when(F.col("target") > 0, F.col("target")))
    return d.withColumn("taken", sum((taken_in_pass(p) for p in range(1, max_repeat)), taken_in_pass(0))).select("doc", "size", "source_size", "target", "start", "finish", "taken")


def taken_in_pass(p: int) -> Column:
    """Words that pass p over the source takes of a document before virtual time 1."""
    return F.least(F.col("size"), F.greatest(F.lit(0), F.floor("target") - p * F.col("source_size") - F.col("start"))).cast("long")


def in_order(plan: DataFrame) -> DataFrame:
    """Globally range-sorted by virtual finish time, equal ones by doc_id; plan has `finish` and doc_id, or `doc` with it."""
    order = ["finish", "doc_id" if "doc_id" in plan.columns else "doc.doc_id"]
    return plan.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_repeat: int = 3, seed: int = SEED) -> DataFrame:
    """The mixture: the columns of docs, a row for each time a document is taken, in order of virtual finish time.

    The one document that each source is at when the budget is spent is cut to the words it still takes; n_chars, where
    there is such a column, follows. Rows are as in mixing_plan; documents that take nothing are left out.
    """
    d = mixing_plan(docs, weights, share, max_repeat, seed).filter("taken > 0")
    d = d.withColumn("words", F.explode(F.filter(F.array(*[F.struct(taken_in_pass(p).alias("n"), F.lit(p).alias("turn")) for p in range(max_repeat)]), lambda x: x["n"] > 0)))
    d = d.withColumn("finish", F.col("finish") + F.col("words.turn") * F.col("source_size") / F.col("target"))
    whole = F.col("doc.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("words.n").cast("int")), "")
    d = d.withColumn("now", F.when(F.col("words.n") < F.col("size"), cut).otherwise(whole))
    out = {"text": F.col("now"), "n_chars": F.length("now").cast("long")}
    return in_order(d).select(*[out.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = mixing_plan(docs, carry=["doc_id"]).select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "start", "finish")
    return in_order(plan)


#: The same by one window over each source; the level is found by trying each source as the first that isn't capped.
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, md5(text))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             3.0::DOUBLE * source_size AS cap, (SELECT sum(source_size) FROM s)::DOUBLE AS budget FROM s),
l AS (SELECT a.source, a.cap / a.weight AS level,
             (any_value(a.budget) - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0))
             / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS share_level
      FROM w a, w b GROUP BY a.source, a.cap, a.weight),
f AS (SELECT min_by(share_level, level) AS fill FROM l WHERE level > share_level),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT fill FROM f) * weight, cap)) AS target FROM w),
x AS (SELECT doc_id, size, source_size, target,
             (sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, floor(target)::BIGINT - start)) + least(size, greatest(0, floor(target)::BIGINT - source_size - start))
        + least(size, greatest(0, floor(target)::BIGINT - 2 * source_size - start)))::BIGINT AS taken, start, CASE WHEN target > 0 THEN (start + size) / target END AS finish
FROM x
"""
