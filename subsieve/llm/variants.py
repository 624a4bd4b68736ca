"""Groups of spelling variants: words one inserted, deleted or replaced letter apart, found by FM-index search schemes.

If one error parts two words, one half of the searched word is intact: the other word begins with its first half or ends
with its second. So a search runs twice, from the delimiter through one half exactly and then across the other half with
one error and on to the other delimiter, in a bidirectional index of a delimited vocabulary: suffix-rank intervals in the
text and in its mirror image, kept in step.

The vocabulary is dealt into shards by the halves that a search could ask for, so a word is looked for in two shards and
kept in a few, each a task's index of about SHARD words. A half with more words than that is cut into blocks, and each
block of searches meets each block of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPOILED = 97  # one in so many (document, run) loses a letter
LEAST_LENGTH, LEAST_COUNT = 5, 3
SHARD = 16_384
_AT_ONCE = 2048  # words searched for at once


class _Side:
    """The suffix ranks of one text: how many rows before a rank have a smaller symbol in front of their suffix."""

    def __init__(self, s: np.ndarray, symbols: int):
        before = s[_ranked(s) - 1]
        self.first = np.append(0, np.cumsum(np.bincount(s, minlength=symbols)))  # rows whose suffix begins with less
        flags = np.zeros((symbols + 1, -(-(len(s) + 1) // 64) * 64), bool)  # [c, row]: a smaller symbol than c in front
        for c in range(1, symbols + 1):
            flags[c, : len(s)] = before < c
        self.bits = np.packbits(flags, axis=1, bitorder="little").view("<u8")
        self.held = np.cumsum(np.bitwise_count(self.bits), axis=1, dtype=np.int64) - np.bitwise_count(self.bits)

    def less(self, c: np.ndarray, row: np.ndarray) -> np.ndarray:
        word = self.bits[c, row >> 6] & ((np.uint64(1) << (row & 63).astype(np.uint64)) - np.uint64(1))
        return self.held[c, row >> 6] + np.bitwise_count(word)


def _ranked(s: np.ndarray) -> np.ndarray:
    """Suffixes in order, up to their first delimiter (0); delimiters are in the order of the text."""
    n, ends = len(s), s == 0
    rank = np.where(ends, np.cumsum(ends) - 1, ends.sum() + s.astype(np.int64))
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        pair = rank * (n + len(s) + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.append(0, np.cumsum(np.diff(pair[order]) != 0))
        if new.max() == n - 1:
            return order
        rank, k = new, 2 * k


class Vocabulary:
    """A bidirectional FM-index of sorted, different words, none of which holds the character 0."""

    def __init__(self, words: list[str]):
        self.words = words
        codes = _codes("\0" + "\0".join(words) + "\0")
        self.symbols, s = np.unique(codes, return_inverse=True)
        self.text, self.mirror = _Side(s, len(self.symbols)), _Side(s[::-1], len(self.symbols))

    def extended(self, back: bool, rows: tuple, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals (start, size, start in the other text) after one more symbol, on the left (back) or the right."""
        side = self.text if back else self.mirror
        start, size, other = rows
        low, high = side.less(c, start), side.less(c + 1, start)
        end = start + size
        to_low, to_high = side.less(c, end), side.less(c + 1, end)
        return side.first[c] + high - low, (to_high - to_low) - (high - low), other + to_low - low

    def one_error(self, asked: list[str], back: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked word, number of the found word): all words with exactly one error in the second half of
        what is asked and its first half intact, or, read backwards, in the first half with the second intact. An error
        between the halves counts for both. No pair comes twice."""
        found = [self._one_error(asked[i : i + _AT_ONCE], back, i) for i in range(0, len(asked), _AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    def _one_error(self, asked: list[str], back: bool, number: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(w) for w in asked])
        codes = _codes("".join(w[::-1] for w in asked) if back else "".join(asked))
        at = np.searchsorted(self.symbols, codes)
        pattern = np.append(np.where(self.symbols[np.minimum(at, len(self.symbols) - 1)] == codes, at, -1), -1)
        begin = np.cumsum(n) - n
        exact = n - n // 2 if back else n // 2

        def step(live, c):  # of (asked, done, start, size, other) those that go on with symbol c
            q, p, *rows = live
            ok = c >= 0
            rows = self.extended(back, tuple(x[ok] for x in rows), c[ok])
            keep = rows[1] > 0
            return [q[ok][keep], p[ok][keep] + 1, *(x[keep] for x in rows)]

        def some(live, which):
            return [x[which] for x in live]

        zero, delimiters = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.words) + 1)
        live, ready, wrong = [np.arange(len(asked)), zero, zero, delimiters, zero], [], []
        while len(live[0]):
            go = live[1] < exact[live[0]]
            ready.append(some(live, ~go))
            live = some(live, go)
            live = step(live, pattern[begin[live[0]] + live[1]])
        live = [np.concatenate(x) for x in zip(*ready, strict=True)]
        letters = np.arange(1, len(self.symbols))
        while len(live[0]):
            q, p = live[:2]
            inside, place = p < n[q], np.minimum(begin[q] + p, len(codes) - 1)
            here = np.where(inside, pattern[place], -1)
            # one letter too many in what is asked; of a run of equal letters only the last one goes
            run = (p + 1 < n[q]) & (codes[place] == codes[np.minimum(place + 1, len(codes) - 1)])
            gone = some(live, inside & ~run)
            wrong.append([gone[0], gone[1] + 1, *gone[2:]])
            # another letter in place of the next one, or before it
            many = [np.repeat(x, len(letters)) for x in live]
            c = np.tile(letters, len(q))
            more = step(many, np.where(c == np.repeat(here, len(letters)), -1, c))
            wrong.append([more[0], more[1] - 1, *more[2:]])
            wrong.append(some(more, more[1] <= n[more[0]]))
            live = some(live, inside)
            live = step(live, here[inside])
        live, ends = [np.concatenate(x) for x in zip(*wrong, strict=True)], []
        while len(live[0]):
            done = live[1] == n[live[0]]
            ends.append(step(some(live, done), np.zeros(done.sum(), int)))
            live = some(live, ~done)
            live = step(live, pattern[begin[live[0]] + live[1]])
        q, _, start, _, other = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else [np.zeros(0, int)] * 5
        return q + number, (start if back else other) - 1  # the delimiter at the very end is the first of all


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters in the texts of docs (doc_id, text), whole, and how often they occur.

    Where SPOILED divides the CRC-32 of '<doc_id>:<run>', the run's letter at that number modulo its length is gone; a
    null id spoils nothing. Null and empty texts have no runs, repeated rows count each.
    """
    w = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    w = w.filter(F.char_length("run") >= least_length).select("doc_id", F.translate("run", UPPER, LOWER).alias("w"))  # spoiled, it would be shorter still
    w = w.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("w")).cast("binary")))
    at = F.pmod("h", F.char_length("w")).cast("int")
    spoiled = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
    w = w.select(F.when(F.col("h") % SPOILED == 0, spoiled).otherwise(F.col("w")).alias("word")).filter(F.char_length("word") >= least_length)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _keys(lengths: Column) -> Column:
    """(back, half) under which searches for words of these lengths look for a word (column word)."""
    some = F.filter(lengths, lambda x: x >= 2)

    def first(h: Column) -> Column:
        return F.struct(F.lit(False).alias("back"), F.substring("word", F.lit(1), h).alias("half"))

    def second(h: Column) -> Column:
        return F.struct(F.lit(True).alias("back"), F.substring("word", F.char_length("word") - h + 1, h).alias("half"))

    firsts = F.array_distinct(F.transform(some, lambda x: F.floor(x / 2).cast("int")))
    seconds = F.array_distinct(F.transform(some, lambda x: x - F.floor(x / 2).cast("int")))
    return F.concat(F.transform(firsts, first), F.transform(seconds, second))


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, near, near_n) of different words (word, n): each with every word one error away. Words have two letters
    at least, shorter ones are near none."""
    spark = words.sparkSession
    small_batches(spark)
    length = F.char_length("word")
    kept = words.select("word", "n", F.explode(_keys(F.array(length - 1, length, length + 1))).alias("k")).select("word", "n", "k.*")
    asked = words.select("word", "n", F.explode(_keys(F.array(length))).alias("k")).select("word", "n", "k.*")
    crowded = kept.groupBy("back", "half").count().filter(F.col("count") > shard).select("back", "half", F.ceil(F.col("count") / shard).alias("blocks"))
    crowded = materialize(crowded, "crowded")
    shards = max(1, -(-2 * words.count() // shard))

    def dealt(rows: DataFrame, own: str, others: str) -> DataFrame:
        rows = rows.join(crowded, ["back", "half"], "left").withColumn("of", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn(own, F.pmod(F.xxhash64("word"), "of")).withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
        alone = F.col("blocks").isNotNull()
        rows = rows.withColumn("crowd", F.when(alone, F.col("half")).otherwise("")).withColumn("shard", F.when(alone, 0).otherwise(F.pmod(F.xxhash64("half"), F.lit(shards).cast("long"))))
        return rows.select(*[F.col(c).alias(c) for c in ("back", "crowd", "i", "j", "shard", "word", "n")])  # names of its own, as both sides come from `words`

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        found = []
        if len(q) and len(v):
            n_of = dict(zip(v["word"].to_pylist(), v["n"].to_pylist(), strict=True))  # a word is kept under several halves
            asked, n, back, index = q["word"].to_pylist(), q["n"].to_pylist(), q["back"][0].as_py(), sorted(n_of)
            for i, j in zip(*(x.tolist() for x in Vocabulary(index).one_error(asked, back)), strict=True):
                word, near = asked[i], index[j]
                if not (back and near.startswith(word[: len(word) // 2])):  # what the forward search finds too
                    found.append((word, n[i], near, n_of[near]))
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "near", "near_n"])

    group = ["back", "crowd", "i", "j", "shard"]
    return dealt(asked, "j", "i").groupBy(*group).cogroup(dealt(kept, "i", "j").groupBy(*group)).applyInArrow(search, "word string, n long, near string, near_n long")


def forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of different words (word, n).

    A word's form is its near word of largest n (ties: the smallest word), if that is at least twice the word's own n,
    else null. Its root is the last form on the way from form to form; as n doubles each time, the way is short, and
    rounds that double what is known of it are fewer still. No words: no rows.
    """
    near = near_words(words)
    both = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionByName(near)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    one = both.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    twice = -F.col("best.less") >= 2 * F.col("n")
    one = one.select("word", "n", "n_near", F.when(twice, F.col("best.near")).alias("form"), F.when(twice, -F.col("best.less")).alias("form_n"))
    one = materialize(one, "forms")
    way = one.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "way")
        way = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return one.join(way, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(materialize(counted_words(table(spark, sf_dir, "documents")), "words"))
