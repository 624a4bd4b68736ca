"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

First candidates come from SimHash fingerprints of the shingles, by op8's search: pairs that differ in at most two of 64
bits, found by deletion-variant signatures. Fingerprints of texts at 0.8 differ in about ten bits, which no signatures of
64 bits find at scale, so what they leave in different groups goes on to min-hash bands: BANDS keys of ROWS minima each,
met by equality joins. A pair at exactly 0.8 shares no key with probability (1 - 0.8 ** ROWS) ** BANDS, 3 in a million.
Each candidate pair of either kind is verified by its exact similarity, so nothing below 0.8 is linked.

Texts with one set of shingles are one node. A key's nodes are first held against its hub only, the node that meets most
others over all its keys, which is the most central one of a group of near copies; so a large group isn't expanded into
pairs. Where that leaves a key's nodes in different groups, blocks of at most BLOCK of them meet, every pair in the first
key that it shares, however many nodes the key has; a task gives back links that join groups only. A pair is compared
unless its sizes, or the parities of its shingles in BITS buckets, rule similarity out: where two sets' parities differ,
one of the shingles in the bucket is in one set only, so the number of such buckets is at most that of the shingles that
aren't shared.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components
from .common import fresh, materialize, small_batches, text_or_empty
from .simhash import majority, near_links

SEED = 42
SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 32, 5
BITS = 1024
BLOCK = 512  # nodes of a block
_BUNDLE = 4 << 20  # bytes of groups that one call compares
_HELD = 48 << 20  # bytes of shingles that a task keeps
_AT_ONCE = 1 << 12
_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, a text without words has none."""
    words = text.encode().lower().split()  # bytes: only A-Z changes, and only 9-13 and space part words
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    h = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        h = h * _STEP + w[i : i + len(h)]
    return np.unique(_mix(h))


def bands(s: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles; none of an empty set."""
    if not len(s):
        return np.array([], np.int64)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(s), _AT_ONCE):
        np.minimum(least, (s[i : i + _AT_ONCE, None] * _FACTORS).min(axis=0), out=least)
    key = _BAND.copy()
    for m in least.reshape(BANDS, ROWS).T:
        key = _mix(key * _STEP + m)
    return key.view(np.int64)


def jaccard(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
    """Similarity of a set of shingles to each of several."""
    sizes = np.array([len(y) for y in ys])
    if not len(x) or not sizes.sum():
        return np.zeros(len(ys))
    flat = np.concatenate(ys)
    hit = np.append(np.uint64(0), np.cumsum(x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat))
    ends = np.cumsum(sizes)
    both = (hit[ends.astype(np.intp)] - hit[(ends - sizes).astype(np.intp)]).astype(np.int64)
    return both / np.maximum(1, len(x) + sizes - both)


def _sets(batches):
    """id, h, node (hash of the set), n (its size), keys and fingerprint of each text."""
    for b in batches:
        nodes, sizes, keys, prints = [], [], [], []
        for t in b.column("text"):
            s = shingles(t.as_py())
            nodes.append(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).astype(np.int64))
            sizes.append(len(s))
            keys.append(bands(s))
            prints.append(majority(s))
        yield pa.RecordBatch.from_arrays(
            [b.column("k"), b.column("h"), b.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())],
            ["k", "h", "doc_id", "node", "n", "keys", "fp"],
        )


def _verified(batches):
    """(a, b) of the pairs (a, b, x, y) whose texts x and y are similar enough; a node's shingles are made once while there is room."""
    held, size = {}, 0

    def of(node, text):
        nonlocal size
        if node not in held:
            if size > _HELD:
                held.clear()
                size = 0
            held[node] = shingles(text)
            size += held[node].nbytes + 200
        return held[node]

    for b in batches:
        ok = [jaccard(of(*x), [of(*y)])[0] >= LEAST for x, y in zip(zip(b.column("a").to_pylist(), _texts(b, "x")), zip(b.column("b").to_pylist(), _texts(b, "y")), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _texts(batch: pa.RecordBatch, name: str):
    return (t.as_py() for t in batch.column(name))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) with k and h, which together tell rows of different ids or texts apart."""
    return docs.select(F.xxhash64("doc_id").alias("k"), F.xxhash64(text_or_empty()).alias("h"), "doc_id", text_or_empty().alias("text"))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that hold by texts (node, text)."""
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "links")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (node, others) with root; nodes without links are their own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """groups (group, node, others) with root, of those whose nodes have different ones."""
    rows = materialize(_with_roots(groups, roots), "rooted")
    apart = rows.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("group")
    return materialize(rows.join(materialize(apart, "apart"), "group", "left_semi"), "open")


def _shingled(batches):
    """(node, s) of (node, text): the bytes of its sorted shingles."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(t.as_py()).tobytes() for t in b.column("text")], pa.binary())], ["node", "s"])


class _Block:
    """The nodes of a block: id, root, number of shingles, keys, and shingles."""

    def __init__(self, node, root, n, keys, sets):
        self.node, self.root, self.n, self.keys = np.asarray(node), np.asarray(root), np.asarray(n), np.stack(list(keys))
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]
        self.parity = np.stack([parities(s) for s in self.sets])


def parities(s: np.ndarray) -> np.ndarray:
    """Whether each of BITS buckets holds an odd number of a set's shingles, packed."""
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).view(np.uint64)


def _joining(a: _Block, b: _Block, band: int) -> list[tuple[int, int]]:
    """Links between two blocks of a group, or within one, that join roots: of pairs whose first shared key is the group's
    and that may be similar."""
    out, joined, apart = [], {}, (1 - LEAST) / (1 + LEAST)

    def top(r):
        while joined.get(r, r) != r:
            r = joined[r]
        return r

    for i, (x, x_root, m) in enumerate(zip(a.node, a.root, a.n, strict=True)):
        ok = (b.root != x_root) & (np.minimum(b.n, m) >= LEAST * np.maximum(b.n, m) - 1e-9)
        if a is b:
            ok &= b.node > x
        some = np.flatnonzero(ok)
        some = some[np.bitwise_count(b.parity[some] ^ a.parity[i]).sum(1) <= apart * (b.n[some] + m) + 1e-6]
        some = some[(b.keys[some] == a.keys[i]).argmax(1) == band]
        for at in range(0, len(some), 64):
            near = some[at : at + 64]
            for j in near[jaccard(a.sets[i], [b.sets[j] for j in near]) >= LEAST]:
                p, q = top(x_root), top(b.root[j])
                if p != q:
                    joined[max(p, q)] = min(p, q)
                    out.append((x, b.node[j]))
    return out


def _within(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of several groups of a block each."""
    out = []
    for _, g in rows.groupby("group", sort=False):
        if len(g) > 1:
            block = _Block(g["node"], g["root"], g["n"], g["keys"], g["s"])
            out += _joining(block, block, g["at"].iat[0])
    return pd.DataFrame(out, columns=["a", "b"])


def _between(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of two blocks of a group, or of one block with itself."""
    out = []
    if len(a) and len(b):
        x = _Block(a["node"], a["root"], a["n"], a["keys"], a["s"])
        y = x if a["i"].iat[0] == a["j"].iat[0] else _Block(b["node2"], b["root2"], b["n2"], b["keys2"], b["s2"])
        out = _joining(x, y, a["at"].iat[0])
    return pd.DataFrame(out, columns=["a", "b"])


def _among_groups(rows: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different roots in rows (group, node, root)."""
    rows = rows.join(nodes.select("node", "n", "keys"), "node").withColumn("at", F.expr("array_position(keys, group) - 1").cast("int"))
    rows = materialize(rows.select("group", "at", "node", "n", "root", "keys"), "members")
    met = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("group", "blocks")
    rows = materialize(rows.join(materialize(met, "sizes"), "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")), "blocks")
    sets = materialize(texts.join(materialize(rows.select("node").distinct(), "compared"), "node", "left_semi").mapInArrow(_shingled, "node long, s binary"), "shingles")
    size = rows.filter("blocks = 1").agg(F.sum(F.col("n").cast("long") * 8 + 300)).first()[0] or 0
    alone = rows.filter("blocks = 1").join(sets, "node").withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(ceil(size / _BUNDLE) or 1).cast("long")))
    alone = alone.groupBy("bundle").applyInPandas(_within, "a long, b long")
    large = rows.filter("blocks > 1").join(sets, "node")
    left = large.select("group", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "at", "node", "n", "root", "keys", "s")
    right = large.select(F.col("group").alias("group2"), F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i2"), F.col("block").alias("j2"), *[F.col(c).alias(f"{c}2") for c in ("node", "n", "root", "keys", "s")])
    met = left.groupBy("group", "i", "j").cogroup(right.groupBy("group2", "i2", "j2")).applyInPandas(_between, "a long, b long")
    return materialize(alone.union(met), "links")


def _pair(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): candidate pairs of nodes (node, fp). Of each fingerprint the least node meets the others, and that of each
    fingerprint within two bits."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    same = nodes.join(first, "fp").filter("node != rep").select(*_pair("node", "rep"))
    near = near_links(first.select("fp")).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return same.union(near.select(*_pair("x", "y"))).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(k, h, doc_id, root) of each row of docs (doc_id, text): rows of one root are linked. Null text is empty."""
    small_batches(docs.sparkSession)
    d = materialize(_keyed(docs).mapInArrow(_sets, f"k long, h long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, n int, keys array<long>, fp long"), "sets")
    nodes = materialize(d.select("node", "k", "h", "n", "keys", "fp").dropDuplicates(["node"]), "nodes")
    alike = materialize(by_fingerprint(nodes.select("node", "fp")), "alike")
    keys = nodes.select("node", "n", F.explode("keys").alias("group"))
    met = keys.groupBy("group").agg(F.count(F.lit(1)).alias("of")).filter("of > 1")
    shared = materialize(keys.join(materialize(met, "met"), "group"), "shared")
    scores = materialize(shared.groupBy("node").agg(F.sum("of").alias("score")), "scores")
    shared = materialize(shared.join(scores, "node"), "scored")
    asked = scores.select("node").union(alike.select("a")).union(alike.select("b"))
    need = nodes.join(asked, "node", "left_semi").select("k", "h", "node")
    texts = materialize(_keyed(docs).join(need, ["k", "h"]).select("node", "text").dropDuplicates(["node"]), "texts")

    found = _links(alike, texts)
    roots = materialize(components(found).toDF("node", "root"), "roots")
    hubs = materialize(shared.groupBy("group").agg(F.max(F.struct("score", "node"))["node"].alias("hub")), "hubs")
    tried = shared.join(hubs, "group").filter("node != hub").select(*_pair("node", "hub")).distinct()
    tried = tried.join(roots.toDF("a", "a_root"), "a", "left").join(roots.toDF("b", "b_root"), "b", "left")
    tried = materialize(tried.filter("coalesce(a_root, a) != coalesce(b_root, b)").select("a", "b"), "tried")
    links = found.union(_links(tried, texts))
    roots = materialize(components(links).toDF("node", "root"), "roots")
    links = links.union(_among_groups(_open(shared.select("group", "node"), roots), nodes, texts))
    roots = materialize(components(links).toDF("node", "root"), "roots")
    return _with_roots(d.select("k", "h", "doc_id", "node"), roots).drop("node")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs (doc_id, text, others) for each group: that of the smallest doc_id, then text hash.

    A row without an id stays if no row of its group has one. Of repeated rows (id and text) one stays.
    """
    best = groups(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "k")).alias("m"))
    k, h = fresh(docs, "_k"), fresh(docs, "_h")
    rows = docs.withColumn(k, F.xxhash64("doc_id")).withColumn(h, F.xxhash64(text_or_empty())).dropDuplicates([k, h])
    return rows.join(best.select(F.col("m.k").alias(k), F.col("m.h").alias(h)), [k, h], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
