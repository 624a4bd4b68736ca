"""SimHash near-duplicates: fingerprints that differ in at most two bits, found by deletion-variant signatures.

A fingerprint is cut into two halves of 32 bits. If two fingerprints differ in at most two bits, one of their halves
differs in at most one bit, so the two share that half with one bit left out, at one place at least. Each distinct
fingerprint is indexed under its 2 x 32 halves with one bit left out; an equality on these keys gives the pairs to
verify. Exact copies are one fingerprint, so they never meet as pairs.

A key with more than CROWD fingerprints (a large group of near copies) isn't expanded into pairs: its fingerprints
meet in the 65 values within one bit of each. Two fingerprints meet in such a value exactly if they differ in at most
two bits, and no value has more than 65 of them, so nothing needs to be verified or capped there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import components
from .common import materialize, small_batches, table, text_or_empty

SEED = 42
SHINGLE = 3
CROWD = 48
_AT_ONCE = 1 << 16


def fingerprint(text: str) -> int:
    """64 bits as a signed number; a bit is set if more than half the shingles' hashes have it. No words: 0."""
    words = text.encode().lower().split()  # bytes: only A-Z changes, and only 9-13 and space part words
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, shingles)), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _AT_ONCE):
        ones += np.unpackbits(h[i : i + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of docs (doc_id, text); null text is empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _key(i: Column) -> Column:
    """Key i of 64: half i // 32 without its bit i % 32, with i above it."""
    half = F.expr("(shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L) & ~shiftleft(1L, i % 32)")
    return half + F.shiftleft(i.cast("long"), 32)


def near_links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that differ in at most two bits.

    All such pairs, but for pairs that only meet in crowded keys: these come as links to the smallest fingerprint they
    meet in a value, which join the same fingerprints into groups.
    """
    keys = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("fp", _key(F.col("i")).alias("key"))
    per_key = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    per_key = materialize(per_key, "keys")
    two = per_key.filter("n = 2").filter("bit_count(a ^ b) <= 2").select("a", "b")
    # a key has two values of its half: so the fingerprints of the keys with more of them are found by their halves
    more = per_key.filter("n > 2").selectExpr("key", "n", "cast(key >> 32 as int) as i", "key & 4294967295L as rest")
    more = more.selectExpr("key", "n", "i", "i div 32 as side", "explode(array(rest, rest | shiftleft(1L, i % 32))) as half")
    halves = fps.select("fp", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("side"))
    halves = halves.selectExpr("fp", "side", "shiftrightunsigned(fp, cast(32 * side as int)) & 4294967295L as half")
    shared = materialize(more.join(halves, ["side", "half"]).select("key", "i", "n", "fp"), "shared")
    # within a key, a pair counts at the bit where its halves differ, or at bit 0 if they are equal
    near = "bit_count(x ^ y) <= 2 and ((shiftrightunsigned(x ^ y, 32 * (i div 32)) & 4294967295L) in (shiftleft(1L, i % 32), if(i % 32 = 0, 0L, -1L)))"
    some = shared.filter(f"n <= {CROWD}").groupBy("key", "i").agg(F.collect_list("fp").alias("all"))
    pair = F.expr(f"flatten(transform(all, x -> transform(filter(all, y -> y < x and {near}), y -> struct(x as a, y as b))))")
    few = some.select(F.explode(pair).alias("p")).select("p.a", "p.b")
    crowd = shared.filter(f"n > {CROWD}").select("fp").distinct()
    meet = crowd.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))")).alias("value"))
    meet = meet.groupBy("value").agg(F.collect_list("fp").alias("all")).filter("size(all) > 1")
    many = meet.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).filter("a > b")
    return two.union(few).union(many).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs (doc_id, text).

    component_id is the smallest doc_id that can be reached over links between fingerprints at two or fewer differing
    bits. Null text is empty; texts without words have fingerprint 0, which links like any other. Null doc_ids keep
    their rows and don't count for the smallest; repeated rows come back each. Empty table: no rows.
    """
    d = materialize(fingerprints(docs), "fingerprints")
    fps = materialize(d.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(near_links(fps.select("fp"))).withColumnRenamed("node", "fp")
    fps = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = fps.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return d.join(fps.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
