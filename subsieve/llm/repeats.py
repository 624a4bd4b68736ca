"""Suffix-array dedup: remove every byte covered by a SPAN-byte string that also starts anywhere else.

A string of SPAN bytes has one anchor: of its GRAM-byte pieces the one with the lowest hash, the leftmost of equals.
Equal strings have equal anchors at equal places, so all comparisons stay within an anchor. A document's strings with
the same anchor start one after another; the bytes that they span are a segment. Anchors that occur once have nothing
to compare. Where all of an anchor's segments are equal, all are repeats. The other anchors' segments, each different
one once, are sharded by anchor, and each shard gets a suffix array by induced sorting and its permuted common
prefixes; strings that share SPAN bytes with a neighbour in order are repeats.

An anchor with more than CROWD different segments isn't gathered in one shard. Its strings are dealt anew, in ranges of
neighbouring starts, by the anchor, the place before it and the bytes that all strings of the range share, which equal
strings have in common; what still meets more than CROWD others is cut into smaller ranges, the last of one start each.
"""

from __future__ import annotations

import hashlib
import struct
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, text_or_empty
from .hashing import Hashes, mixed
from .suffixes import permuted_prefixes, suffix_array

SPAN, GRAM = 200, 32
WINDOW = SPAN - GRAM + 1  # pieces of a string
CROWD = 2000
WIDTHS = (85, 16, 4, 1)
SHARD_BYTES = 2 << 20
_AT_ONCE = 1 << 17  # bytes whose hashes are held at a time


def lowest_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Of each `width` (up to 256) neighbours of h, the place of the lowest 24 high bits, leftmost of equals.

    A window is the end of a block and the start of the next: running minima from both sides of (bits, place in the
    block) give the leftmost lowest of each part.
    """
    n = len(h)
    blocks = np.full(-(-n // width) * width, 0xFFFFFFFF, np.uint32)
    blocks[:n] = (h >> np.uint64(40)).astype(np.uint32) << np.uint32(8)
    blocks = blocks.reshape(-1, width)
    blocks |= np.arange(width, dtype=np.uint32)
    m = n - width + 1
    head = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + m]
    tail = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()[:m]
    base = np.arange(0, len(blocks) * width, width).repeat(width)
    left = (tail >> np.uint32(8)) <= (head >> np.uint32(8))
    left[::width] = True  # a window that is a block
    return np.where(left, base[:m] + (tail & np.uint32(255)), base[width - 1 : width - 1 + m] + (head & np.uint32(255)))


def anchors(data: bytes, ends: np.ndarray | None = None):
    """(anchor hash, segment hash, first start, last start, text number) of each run of strings with one anchor.

    `data` holds texts one after another that end at `ends`; strings don't cross ends.
    """
    whole = np.frombuffer(data, np.uint8)
    if len(whole) < SPAN:
        return
    ends = np.array([len(whole)]) if ends is None else ends
    hashes = Hashes(whole)
    h = hashes.of(slice(0, len(whole) - GRAM + 1), slice(GRAM, len(whole) + 1))
    low = lowest_in_windows(h, WINDOW)
    begins = np.append(0, ends[:-1])
    inside = np.zeros(len(low) + 1, np.int32)
    some = np.flatnonzero(ends - begins >= SPAN)
    inside[begins[some]] += 1
    inside[ends[some] - SPAN + 1] -= 1
    ok = np.cumsum(inside[:-1]) > 0
    new = np.append(True, (low[1:] != low[:-1]) | (ok[1:] != ok[:-1]))
    new[begins[some]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    first, last = first[ok[first]], last[ok[first]]
    # where the anchor is in the segment counts too: the same bytes around another anchor are other strings
    segment = hashes.of(first, last + SPAN) ^ mixed((low[first] - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64))
    owner = np.searchsorted(ends, first, side="right")
    return h[low[first]].view(np.int64), segment.view(np.int64), first - begins[owner], last - begins[owner], owner


def _groups(rows):
    """Rows (k, text) as (list of k, bytes, ends, offset of the first text), of about _AT_ONCE bytes; longer texts in parts."""
    keys, parts, size = [], [], 0
    for k, t in rows:
        data = t.encode()
        if len(data) > _AT_ONCE:
            for begin in range(0, len(data) - SPAN + 1, _AT_ONCE):  # a run cut by a part's end is two rows
                part = data[begin : begin + _AT_ONCE + SPAN - 1]
                yield [k], part, np.array([len(part)]), begin
        elif len(data) >= SPAN:
            keys.append(k)
            parts.append(data)
            size += len(data)
            if size >= _AT_ONCE:
                yield keys, b"".join(parts), np.cumsum([len(x) for x in parts]), 0
                keys, parts, size = [], [], 0
    if keys:
        yield keys, b"".join(parts), np.cumsum([len(x) for x in parts]), 0


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(k, anchor, segment, s0, s1) of docs (k, text)."""

    def run(batches):
        for b in batches:
            for keys, data, ends, offset in _groups(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                h, segment, s0, s1, owner = anchors(data, ends)
                columns = (np.array(keys, np.int64)[owner], h, segment, (s0 + offset).astype(np.int32), (s1 + offset).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "anchor", "segment", "s0", "s1"])

    return docs.mapInArrow(run, "k long, anchor long, segment long, s0 int, s1 int")


def repeated_starts(segments: list[bytes]) -> list[np.ndarray]:
    """For each of several different segments, at which places a string starts that also starts elsewhere in them.

    All segments are one text, parted by a symbol below all bytes: a string comes again if its suffix and a neighbour in
    order have SPAN bytes in common.
    """
    sizes = np.array([len(x) + 1 for x in segments])
    begin = np.cumsum(sizes) - sizes
    s = np.frombuffer(b"\0".join([*segments, b""]), np.uint8).astype(np.int32) + 1
    s[begin + sizes - 1] = 0  # parts the segments
    order = suffix_array(s)
    before, common = permuted_prefixes(s, order)
    long = common >= SPAN
    long[before[long]] = True
    at = np.flatnonzero(long)
    owner = np.searchsorted(begin, at, side="right") - 1
    return np.split(at - begin[owner], np.cumsum(np.bincount(owner, minlength=len(segments)))[:-1])


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of ascending starts whose strings overlap or touch."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > SPAN)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k, spans array<struct<a, b>>) of docs (k, text): runs of bytes to remove, of documents that have some.

    Rows with the same k must have the same text; their spans come once.
    """
    small_batches(docs.sparkSession)
    rows = anchor_rows(docs)
    again = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("segment").alias("x"), F.max("segment").alias("y")).filter("n > 1")
    again = materialize(again.selectExpr("anchor", "x = y as same"), "again")  # written, so that the join can split the rows of a hot anchor
    found = materialize(rows.join(again, "anchor"), "anchors")
    differ = found.filter("not same")
    each = differ.groupBy("anchor", "segment").agg(F.min(F.struct("k", "s0", "s1")).alias("one"), F.count(F.lit(1)).alias("n"))
    each = materialize(each.select("anchor", "segment", "one.*", (F.col("n") > 1).alias("copied")), "segments")
    crowds = materialize(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter(f"m > {CROWD}").select("anchor", F.lit(True).alias("crowd")), "crowds")
    each = each.join(crowds, "anchor", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))

    bytes_of = F.substring(F.col("text").cast("binary"), F.col("s0") + 1, F.col("s1") - F.col("s0") + SPAN)
    cut = each.join(docs.dropDuplicates(["k"]), "k").select("anchor", "segment", "copied", "crowd", bytes_of.alias("bytes"))
    cut = materialize(cut.select("anchor", "segment", "copied", "crowd", F.lit(0).alias("low"), (F.octet_length("bytes") - SPAN).alias("high"), "bytes"), "cut")

    small, parts = [cut.filter("not crowd").select(F.xxhash64("anchor").alias("key"), *_PART)], []
    rest = cut.filter("crowd").select(*_PART)
    for width in WIDTHS:
        if rest.isEmpty():
            break
        done, few, rest = narrowed(rest, width)
        parts.append(done)
        small.append(few)
    parts.append(by_shards(reduce(DataFrame.union, small)))
    parts = materialize(reduce(DataFrame.union, parts), "parts")
    hit = differ.join(parts, ["anchor", "segment"]).select("k", (F.col("s0") + F.col("low")).alias("a"), (F.col("s0") + F.col("high") + SPAN).alias("b"))
    whole = found.filter("same").select("k", F.col("s0").alias("a"), (F.col("s1") + SPAN).alias("b"))
    return hit.union(whole).groupBy("k").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


_PART = ["anchor", "segment", "copied", "low", "high", "bytes"]


def by_shards(segments: DataFrame) -> DataFrame:
    """(anchor, segment, low, high): runs of starts of repeated strings, from suffix arrays over all segments
    (key, anchor, segment, copied, low, high, bytes) of the same shard; a key's segments are in one shard."""

    def one_shard(rows: pd.DataFrame) -> pd.DataFrame:
        starts = repeated_starts(rows["bytes"].tolist())
        out = []
        for a, s, low, x, copied, at in zip(*(rows[c] for c in ("anchor", "segment", "low", "bytes", "copied")), starts, strict=True):
            runs = _runs(np.arange(len(x) - SPAN + 1) if copied else at)
            out += [(a, s, low + first, low + last) for first, last in runs]
        return pd.DataFrame(out, columns=["anchor", "segment", "low", "high"])

    total = segments.agg(F.sum(F.octet_length("bytes").cast("long"))).first()[0] or 0
    shards = max(1, ceil(total / SHARD_BYTES))
    few = segments.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards).cast("long")))
    return few.groupBy("shard").applyInPandas(one_shard, "anchor long, segment long, low int, high int")


def narrowed(rest: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts of crowded anchors cut into ranges of `width` starts and told apart by the bytes that a range's strings share.

    Returns (anchor, segment, low, high) of the ranges that come again as a whole; the ranges, each different one once,
    that meet few others, for shards; and those that still meet more than CROWD others, to be cut again. With a width of
    1 a range's strings share all their bytes, so none is left.
    """
    cut = materialize(rest.mapInArrow(_ranges(width), ", ".join(f"{c} {rest.schema[c].dataType.simpleString()}" for c in _PART) + ", key long, content long"), "ranges")
    each = cut.groupBy("anchor", "key", "content").agg(F.count(F.lit(1)).alias("n"), F.max("copied").alias("c"), F.min(F.struct("segment", "low")).alias("one"))
    each = materialize(each.selectExpr("anchor", "key", "content", "n > 1 or c as again", "one.segment", "one.low"), "contents")
    met = materialize(each.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "met")
    done = cut.join(each.filter("again").select("anchor", "key", "content"), ["anchor", "key", "content"], "left_semi").select("anchor", "segment", "low", "high")
    one = materialize(each.join(met, ["anchor", "key"]), "open").select("anchor", "key", "segment", "low", "again", "m")
    one = materialize(one.join(cut.drop("copied"), ["anchor", "key", "segment", "low"]).withColumnRenamed("again", "copied"), "one")
    few = one.filter(f"m <= {CROWD}").select(F.xxhash64("anchor", "key").alias("key"), *_PART)
    return done, few, one.filter(f"m > {CROWD}").select(*_PART)


def _ranges(width: int):
    """Cuts the starts low to high of a part into ranges of `width` places before the anchor, each with its own bytes, a
    hash of those that all strings of a whole range there share, and one of all its bytes and its place."""
    schema = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("copied", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary()), ("key", pa.int64()), ("content", pa.int64())])
    digest = lambda x, *n: int.from_bytes(hashlib.blake2b(x, digest_size=8, key=struct.pack(f"<{len(n)}i", *n)).digest(), "little", signed=True)

    def run(batches):
        for b in batches:
            out = []
            for a, s, c, low, high, x in zip(*(b.column(n).to_pylist() for n in _PART), strict=True):
                data = np.frombuffer(x, np.uint8)
                p = int(lowest_in_windows(Hashes(data).of(slice(0, len(x) - GRAM + 1), slice(GRAM, len(x) + 1)), WINDOW)[0])
                for k in range((p - high + low) // width, p // width + 1):
                    first, last = p - (k + 1) * width + 1, p - k * width  # the starts of a whole range, from the part's first
                    y, z = max(first, 0), min(last, high - low)
                    own = x[y : z + SPAN]
                    out.append((a, s, c, low + y, low + z, own, digest(x[last : first + SPAN], k), digest(own, k, p - y, z - y)))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<a, b>>, kept binary) of each row of docs (doc_id, text).

    spans: maximal runs of removed bytes; kept: the other bytes. Null text is empty; texts of fewer than SPAN bytes keep
    all. Rows that repeat (same id and text, or same text) lose what they share, so a copied text of SPAN bytes or more
    keeps nothing. Empty table: no rows.
    """
    keyed = docs.select(F.xxhash64("doc_id", text_or_empty()).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    spans = repeated_spans(keyed.select("k", "text"))
    both = keyed.select("k", "doc_id", "text").join(spans, "k", "left").select("doc_id", "text", "spans")

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("kept", pa.binary())])
        for b in batches:
            out = [[], [], [], []]
            for i, t, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, runs = t.encode(), []
                for a, e in sorted((x["a"], x["b"]) for x in spans or ()):
                    if runs and a <= runs[-1]["b"]:
                        runs[-1]["b"] = max(runs[-1]["b"], e)
                    else:
                        runs.append({"a": a, "b": e})
                ends = [0, *(r["b"] for r in runs)]
                kept = b"".join(data[x:y] for x, y in zip(ends, [*(r["a"] for r in runs), len(data)], strict=True))
                for c, v in zip(out, (i, len(data), runs, kept), strict=True):
                    c.append(v)
                if len(out[0]) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out = [[], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<a: int, b: int>>, kept binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return d.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
