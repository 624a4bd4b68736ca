"""Stupid-backoff scores of documents under a bigram model of all other documents.

The score of a word after another is c(both) / c(first) if any other document has the two in a row, else ALPHA times
the word's share of all words; counts leave out the document that is scored. The plan is that of a relational one, on
packed rows: documents are dealt into chunks of a few MB; a chunk's distinct words and bigrams, as 64-bit hashes, go to
the bucket of their hash with their counts; a bucket sums the counts of all chunks (the count table of its hashes) and
joins them back to each chunk's n-grams; the chunk sums per document. Chunks and buckets grow in number, not in size.
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, small_batches, table, text_or_empty
from .hashing import Hashes, mixed

ALPHA = 0.4
UNSEEN = 0.5  # count of a word that no other document has
CHUNK = 8 << 20  # bytes of text
_AT_ONCE = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word of a text, in order; long texts are cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _AT_ONCE)
        while end < len(data) and not _WHITE[data[end]]:
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        gap = np.concatenate([[True], _WHITE[part], [True]])
        start, stop = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        out.append(Hashes(part).of(start, stop))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Grams:
    """The words and bigrams of several texts: text number and place in the sorted distinct hashes for each."""

    def __init__(self, texts):
        hashes = [word_hashes(t.encode()) for t in texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.owner = np.repeat(np.arange(len(hashes)), self.sizes)
        self.words, self.word = np.unique(words, return_inverse=True)
        self.inner = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1  # places of words that have one before
        pairs = mixed(words[self.inner - 1] * np.uint64(3) + words[self.inner] ^ np.uint64(0x5851F42D4C957F2D))
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)

    def own(self, place: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How often the same text has the n-gram, for each."""
        _, back, count = np.unique(owner * max(1, n) + place, return_inverse=True, return_counts=True)
        return count[back]


def _packed(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte by byte from all, so that the high bytes compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def scores(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, n_seen (bigrams that other documents have), log_score (sum of the words' log scores), mean_score.

    `docs` has doc_id and text. A text's first word counts by its share of all words. Null text is empty: no words, sum
    0, mean null. Repeated rows are documents of their own. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    size = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, ceil(size / CHUNK))
    bits = max(1, ceil(log2(chunks)))
    # by where they are read, too, so that repeated rows don't all meet
    d = d.select(F.pmod(F.xxhash64("doc_id", "text", F.input_file_name(), F.input_file_block_start()), F.lit(chunks).cast("long")).alias("chunk"), "doc_id", "text")

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        g = Grams(rows["text"])
        out = [(0, 0, _packed(np.zeros(1, np.uint64)), np.array([len(g.word)], np.int64).tobytes())]
        for order, keys, place in ((1, g.words, g.word), (2, g.pairs, g.pair)):
            counts = np.bincount(place, minlength=len(keys)).astype(np.int64)
            edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            for bucket in np.flatnonzero(np.diff(edges)):
                part = slice(edges[bucket], edges[bucket + 1])
                out.append((order, int(bucket), _packed(keys[part]), counts[part].tobytes()))
        return pd.DataFrame([(rows["chunk"].iat[0], *r) for r in out], columns=["chunk", "gram", "bucket", "keys", "counts"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [_unpacked(k) for k in rows["keys"]]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(place.max() + 1, np.int64)
        np.add.at(totals, place, np.frombuffer(b"".join(rows["counts"]), np.int64))
        found = np.split(totals[place], np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"chunk": rows["chunk"], "gram": rows["gram"], "bucket": rows["bucket"], "counts": [f.tobytes() for f in found]})

    def score(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values(["gram", "bucket"])
        total, one, two = (np.frombuffer(b"".join(counts.loc[counts["gram"] == n, "counts"]), np.int64) for n in (0, 1, 2))
        g = Grams(rows["text"])
        alone = one[g.word] - g.own(g.word, g.owner, len(g.words))
        both = two[g.pair] - g.own(g.pair, g.owner[g.inner], len(g.pairs))
        rest = np.maximum(1, total[0] - g.sizes)[g.owner]
        log = np.log(np.where(alone > 0, alone, UNSEEN)) - np.log(rest)
        seen = np.zeros(len(log), bool)
        seen[g.inner] = both > 0
        log[g.inner] += np.log(alpha)
        log[seen] = np.log(both[both > 0]) - np.log(alone[g.inner - 1][both > 0])
        n, sums = len(rows), np.bincount(g.owner, log, minlength=len(rows))
        hits = np.bincount(g.owner, seen, minlength=n).astype(np.int64)
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n_words": g.sizes, "n_seen": hits, "log_score": sums})

    asked = d.groupBy("chunk").applyInPandas(ask, "chunk long, gram int, bucket long, keys binary, counts binary")
    counted = asked.groupBy("gram", "bucket").applyInPandas(count, "chunk long, gram int, bucket long, counts binary")
    out = d.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(score, "doc_id long, n_words long, n_seen long, log_score double")
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def scores_by_join(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The same scores by plain joins: count tables partitioned by hash, joined to the exploded n-grams, summed per row.

    Every n-gram of every document is a row in five joins, so it moves many times the input; scores() packs them.
    """
    h = lambda w: F.xxhash64(w)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.transform(F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0)), h).alias("words"))
    d = materialize(d, "words")
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.col("words")[i - 1]).alias("v")))
    grams = d.select("row", F.explode(pairs).alias("g")).groupBy("row", "g.w", "g.v").agg(F.count(F.lit(1)).alias("n"))
    grams = materialize(grams, "grams")
    own = materialize(grams.groupBy("row", "w").agg(F.sum("n").alias("own")), "own")
    one = materialize(own.groupBy("w").agg(F.sum("own").alias("c")), "one")
    two = materialize(grams.filter("v is not null").groupBy("v", "w").agg(F.sum("n").alias("both")), "two")
    sizes = d.select("row", "doc_id", F.size("words").cast("long").alias("n_words"))
    total = sizes.agg(F.sum("n_words")).first()[0] or 0
    x = grams.join(one, "w").join(own, ["row", "w"]).withColumn("alone", F.col("c") - F.col("own")).drop("c", "own")
    first = own.join(one, "w").select("row", F.col("w").alias("v"), (F.col("c") - F.col("own")).alias("first"))
    x = x.join(two, ["v", "w"], "left").join(first, ["row", "v"], "left").join(sizes, "row")
    both, seen = F.col("both") - F.col("n"), F.coalesce(F.col("both") - F.col("n") > 0, F.lit(False))
    back = F.log(F.when(F.col("alone") > 0, F.col("alone").cast("double")).otherwise(UNSEEN)) - F.log(F.greatest(F.lit(1), F.lit(total) - F.col("n_words"))) + F.when(F.col("v").isNotNull(), log(alpha)).otherwise(0.0)
    score = F.when(seen, F.log(both) - F.log("first")).otherwise(back)
    s = x.groupBy("row").agg(F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("n_seen"), F.sum(F.col("n") * score).alias("log_score"))
    out = sizes.join(s, "row", "left").select("doc_id", "n_words", F.coalesce("n_seen", F.lit(0)).alias("n_seen"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scores(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_seen", F.round("log_score", 6).alias("log_score"), F.round("mean_score", 6).alias("mean_score"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
g AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t),
n AS (SELECT doc_id, count(*) AS words FROM t GROUP BY doc_id),
dw AS (SELECT doc_id, w, count(*) AS own FROM t GROUP BY doc_id, w),
w AS (SELECT w, sum(own) AS c FROM dw GROUP BY w),
dp AS (SELECT doc_id, v, w, count(*) AS own FROM g WHERE v IS NOT NULL GROUP BY doc_id, v, w),
p AS (SELECT v, w, sum(own) AS c FROM dp GROUP BY v, w),
x AS (SELECT g.doc_id, g.v, w.c - dw.own AS alone, p.c - dp.own AS both_, wv.c - dv.own AS first_,
             greatest(1, (SELECT sum(words) FROM n) - n.words) AS rest
      FROM g JOIN n USING (doc_id) JOIN dw USING (doc_id, w) JOIN w USING (w)
      LEFT JOIN dp ON dp.doc_id = g.doc_id AND dp.v = g.v AND dp.w = g.w LEFT JOIN p ON p.v = g.v AND p.w = g.w
      LEFT JOIN dw dv ON dv.doc_id = g.doc_id AND dv.w = g.v LEFT JOIN w wv ON wv.w = g.v),
s AS (SELECT doc_id, coalesce(both_, 0) > 0 AS seen,
             CASE WHEN both_ > 0 THEN ln(both_::DOUBLE) - ln(first_::DOUBLE)
                  ELSE ln(CASE WHEN alone > 0 THEN alone::DOUBLE ELSE {UNSEEN}::DOUBLE END) - ln(rest::DOUBLE)
                       + CASE WHEN v IS NULL THEN 0 ELSE ln({ALPHA}::DOUBLE) END END AS score FROM x)
SELECT d.doc_id, count(s.doc_id) AS n_words, count(*) FILTER (s.seen) AS n_seen,
       round(coalesce(sum(score), 0), 6) AS log_score, round(sum(score) / count(s.doc_id), 6) AS mean_score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
