"""Ranked lexical search of many queries at once, sharing what their terms have in common.

Items that are asked together share many terms. Term sets that several items hold are mined first: every item's terms
are put in order of how many items have them, and the pair of neighbours that most items share becomes a node, again and
again, until no pair is shared. So an item is a short list of nodes, and a node the sum of two others, in a graph that
all items share. Where documents are scored, the partial sums of a node (one number for each document of a block) are
worked out once, from those of its two parts, and an item's scores from its nodes. A node none of whose terms occur in
the block has no sums, one with a single live part is that part.

Documents are read twice: once for how often each asked term occurs, kept as numbers, and once these numbers are scored.
A task returns each item's best documents only. Items are taken in blocks of BLOCK_TERMS terms, each a reading of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

BLOCK_TERMS = 200_000  # terms of the items, with repeats, that are searched for in one reading
CELLS = 1 << 22  # partial sums that a task holds at once, about
MERGED = 64  # groups in which the tasks' best documents of an item are ranked first

#: Bytes of a term: all but these are white space and punctuation, and every byte of a letter beyond ASCII is above 127.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # of bytes, lower() changes A-Z only


class SharedTerms:
    """The graph of shared term sets of some items, each a list of term numbers below `terms`.

    Node i < terms is a term; node terms + k is the sum of left[k] and right[k], which come before it. Items are lists of
    nodes, one after another in `parts`, item i from starts[i] on.
    """

    def __init__(self, items: list[list[int]], terms: int):
        popular = Counter(t for item in items for t in set(item))
        # a term that an item repeats counts as often
        now = [sorted(item, key=lambda t: (-popular[t], t)) for item in items]
        left, right = [], []
        while True:
            shared = Counter(p for item in now for p in set(zip(item, item[1:])))  # noqa: B905
            # pairs that don't share a node with a better one are merged together
            best, taken = {}, set()
            for (a, b), n in sorted(((p, n) for p, n in shared.items() if n > 1), key=lambda x: (-x[1], x[0])):
                if a not in taken and b not in taken:
                    best[a, b] = terms + len(left)
                    left.append(a)
                    right.append(b)
                    taken |= {a, b}
            if not best:
                break
            now = [self._merged(item, best) for item in now]
        self.terms, self.left, self.right = terms, np.array(left, np.int64), np.array(right, np.int64)
        depth = np.zeros(terms + len(left), np.int64)
        for k, (a, b) in enumerate(zip(left, right, strict=True)):
            depth[terms + k] = 1 + max(depth[a], depth[b])
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        self.parts = np.array([n for item in now for n in item], np.int64)
        self.starts = np.cumsum([0, *map(len, now)])

    @staticmethod
    def _merged(item: list[int], best: dict) -> list[int]:
        out, i = [], 0
        while i < len(item):
            node = best.get((item[i], item[i + 1])) if i + 1 < len(item) else None
            out.append(item[i] if node is None else node)
            i += 1 if node is None else 2
        return out

    def totals(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """[item, document]: sums over the item's terms of the values given for (term, document), each pair once."""
        found = np.unique(term)
        row = np.zeros(self.terms + len(self.left), np.int64)  # of each node's sums; row 0 is empty
        row[found] = np.arange(1, len(found) + 1)
        sums = np.zeros((1 + len(found) + len(self.left), docs), np.int64)
        sums[row[term], doc] = value
        used = 1 + len(found)
        for level in self.levels:
            a, b = row[self.left[level - self.terms]], row[self.right[level - self.terms]]
            both = (a > 0) & (b > 0)
            row[level] = np.where(both, 0, a + b)  # of one live part: its own
            n = int(both.sum())
            sums[used : used + n] = sums[a[both]]
            sums[used : used + n] += sums[b[both]]
            row[level[both]] = np.arange(used, used + n)
            used += n
        parts = row[self.parts]
        live = np.append(0, np.cumsum(parts > 0))[self.starts]  # where each item's live parts start
        out = np.zeros((len(self.starts) - 1, docs), np.int64)
        some = np.flatnonzero(np.diff(live))
        if len(some):
            out[some] = np.add.reduceat(sums[parts[parts > 0]], live[some], axis=0)
        return out


class _Best:
    """The k best documents of each item so far: highest score, then smallest id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.none()

    def none(self) -> None:
        self.item, self.score, self.doc, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        item, at = np.nonzero((scores >= self.least[:, None]) & (scores > 0))
        self.item, self.score = np.append(self.item, item), np.append(self.score, scores[item, at])
        self.doc, self.null = np.append(self.doc, docs[at]), np.append(self.null, null[at])
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        item = self.item[order]
        begin = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - begin[item]
        order, last = order[place < self.k], order[place == self.k - 1]
        self.least[self.item[last]] = self.score[last]
        self.item, self.score, self.doc, self.null = self.item[order], self.score[order], self.doc[order], self.null[order]


def _counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id long, n, terms array<int>, tf array<int>) of the documents that hold any term at all: how many terms with
    repeats, and which of the given ones occur how often."""
    known = docs.sparkSession.sparkContext.broadcast(terms)  # BLOCK_TERMS and one item's at most

    def run(batches):
        get = known.value.get
        for b in batches:
            ids, ns, found, tf, ends = [], [], [], [], [0]
            for i, text in zip(b.column(0), b.column(1), strict=True):  # one text at a time
                words = terms_of(text.as_py())
                if words:
                    count = Counter(map(get, words))
                    count.pop(None, None)
                    ids.append(i.as_py())
                    ns.append(len(words))
                    found += count.keys()
                    tf += count.values()
                    ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found, tf)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    small_batches(docs.sparkSession)
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _searched(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    """(item int, item_id, doc_id, score): of each task of documents, each item's k best."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted({t for _, words in items for t in words}))}
    counted = materialize(_counted(docs, number), "counted")
    n_docs, all_terms = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(number), np.int64)
    for t, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each asked term
        weight[t] = floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))
    graph = SharedTerms([[number[t] for t in words] for _, words in items], len(number))
    shared = spark.sparkContext.broadcast((graph, weight, [i for i, _ in items]))
    at_once = max(16, min(1024, CELLS // max(1, len(number) + len(graph.left) + len(graph.parts))))

    def run(batches):
        graph, weight, ids = shared.value
        best = _Best(len(ids), k)
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                b = whole.slice(at, at_once)
                doc, n, terms, tf = b.columns
                m = 100 - 25 + 25 * n.to_numpy() * n_docs // all_terms
                of = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
                t, f = terms.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
                value = weight[t] * (1_000_000_000 * f // (1000 * f + 12 * m[of]))
                null = doc.is_null().to_numpy(zero_copy_only=False)
                best.add(graph.totals(t, of, value, b.num_rows), doc.fill_null(0).to_numpy(), null)
        columns = [pa.array(best.item, pa.int32()), pa.array([ids[i] for i in best.item], pa.int64()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id long, rank int, doc_id long, score long): for each item (item_id, text) its k best documents of docs
    (doc_id, text) with a score above 0, or all, if fewer; equal scores by ascending doc_id, null last.

    Texts are read whole. Null and texts without terms hold nothing: such documents don't count, such items find nothing.
    Repeated rows of docs are documents of their own; repeated rows of items are one item, two texts under one id two.
    """
    asked = items.filter("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct()
    asked = materialize(asked, "asked")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (8 * block_terms)))  # a term takes 8 bytes or so
    found = []
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()  # a block
        best = _searched(docs, [(r["item_id"], terms_of(bytes(r["text"]))) for r in rows], k)
        found.append(materialize(best.withColumn("block", F.lit(i)), "best"))
    found = reduce(DataFrame.unionByName, found)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGED))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("block", "item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP13_SQL = f"""
with rows as (select row_number() over () as r, doc_id, text from documents where text is not null),
words as (select r, doc_id, unnest({_TERMS}) as term from rows),
tf as (select r, doc_id, term, count(*) as tf from words group by all),
sizes as (select r, sum(tf)::bigint as n from tf group by r),
whole as (select count(*) as n_docs, sum(n)::bigint as all_terms from sizes),
asked as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
held as (select term, count(*) as df from tf where term in (select term from asked) group by term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from held, whole),
scored as (select a.item_id, tf.r, tf.doc_id, sum(a.times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // all_terms))))::bigint as score
  from asked a join tf using (term) join weights using (term) join sizes using (r), whole group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""
