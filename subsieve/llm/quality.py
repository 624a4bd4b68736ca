"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One latent score, from hashed-text weights that all grades share, and an ordered threshold between each two
neighbouring grades: P(grade > k) = sigmoid(score - threshold k). The score is the sum of the weights of the features
that the model kept, over the root of their number, so that much evidence of one kind doesn't count as another. From
these come the expected grade and the tail probability of the best grade, by which documents are selected. The model is
fitted on a bounded sample of rated documents; every document is scored whole, where it is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowest, small_batches, table

BITS = 22  # of the hash that features share
SAMPLE = 12_000  # rated documents that the model is fitted on, at most
LEAST_DOCS = 5  # documents of the sample that a feature must be in
LEAST_Z, LEAST_OFF = 4.0, 0.45  # standard errors, and share, by which its documents' grades must be off
ROUNDS, RATE, PENALTY = 400, 0.3, 1e-5
KEEP = 0.8  # least tail probability of documents that stay
_REMEMBERED = 150_000


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself, two prefixes, its trailing signs, and whether it is in capitals."""
    bare = word.strip("\"'()[]{}<>.,;:!?#$%&*|-_=+~^/\\@`")
    low = bare.lower()
    found = [f"w {low}"] if bare else []
    found += [f"{n} {low[:n]}" for n in (4, 5) if len(low) > n]
    if tail := word[len(word.rstrip("!?#$%&*|-_=+~^/\\@`")) :]:
        found.append(f"t {tail[:3]}")
    if len(bare) > 1 and bare.isupper():
        found.append("capitals")
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) >> (32 - BITS) for f in found]


def shape_feature(words: int, distinct: int) -> int:
    """How many words there are, by powers of two, and what share of them differ, by tenths."""
    shape = f"shape {int(log2(words + 1))} {10 * distinct // max(1, words)}"
    return zlib.crc32(shape.encode()) >> (32 - BITS)


def features(text: str) -> np.ndarray:
    """Features of each distinct word and of the shape of the whole text; a feature counts for each word that has it."""
    words = text.split()
    distinct = sorted(set(words))
    return np.array([f for w in distinct for f in word_features(w)] + [shape_feature(len(words), len(distinct))], np.int32)


@dataclass(frozen=True)
class Model:
    grades: tuple[int, ...]  # as rated, from worst to best
    weights: dict[int, float]  # of the features that the model kept
    thresholds: np.ndarray  # ascending, one less than grades

    def weigh(self, found: Iterable[int]) -> complex:
        """The sum of the weights of features, and in the imaginary part how many the model kept, so that one sum has both."""
        w = [self.weights[f] for f in found if f in self.weights]
        return complex(sum(w), len(w))

    def cut(self, least: float) -> float:
        """Least tail probability of documents that stay: `least`, or that of a document without evidence, if it is lower."""
        return min(least, float(self.tails(np.zeros(1))[0, -1]) - 1e-9)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -60, 60)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(score) @ np.diff(np.array(self.grades, float))


def score_of(total: complex) -> float:
    return total.real / max(1, total.imag) ** 0.5


def loss(w: np.ndarray, t: np.ndarray, row: np.ndarray, at: np.ndarray, scale: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the levels y with the penalty of the weights, and its gradients by weights w and thresholds t.

    (row, at): document and feature of each occurrence; scale: of each document's score.
    """
    k, i = len(t), np.arange(len(y))
    s = np.bincount(row, w[at], minlength=len(y)) * scale
    cdf = 1 / (1 + np.exp(np.clip(s[:, None] - t[None], -60, 60)))  # P(grade <= k)
    cdf = np.hstack([np.zeros((len(y), 1)), cdf, np.ones((len(y), 1))])
    upper, lower = cdf[i, y + 1], cdf[i, y]
    p = np.maximum(upper - lower, 1e-12)
    up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
    gs = (up - low) / len(y)  # of the loss by the score
    gt = np.zeros(k)
    np.add.at(gt, np.minimum(y, k - 1), np.where(y < k, -up, 0) / len(y))
    np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, low, 0) / len(y))
    gw = np.bincount(at, (gs * scale)[row], minlength=len(w)) + PENALTY * w
    return float(-np.log(p).mean() + PENALTY / 2 * (w**2).sum()), gw, gt


def fit_rows(grades: np.ndarray, docs: list[np.ndarray], rounds: int = ROUNDS) -> Model | None:
    """Full-batch gradient steps, scaled for each weight by the gradients so far. None if the documents that aren't copies have one grade."""
    docs = [np.unique(d, return_counts=True) for d in docs]
    first = _first_of_copies([d for d, _ in docs])
    docs = [docs[i] for i in first]
    levels, y = np.unique(grades[first], return_inverse=True)
    if len(levels) < 2:
        return None
    useful = np.flatnonzero(_useful([d for d, _ in docs], y))
    place = np.full(1 << BITS, -1, np.int32)
    place[useful] = np.arange(len(useful))
    found = [np.repeat(place[d], n) for d, n in docs]
    found = [f[f >= 0] for f in found]
    sizes = np.array([len(f) for f in found])
    row, at = np.repeat(np.arange(len(found)), sizes), np.concatenate(found)
    scale = 1 / np.sqrt(np.maximum(1, sizes))
    w, below = np.zeros(len(useful)), np.cumsum(np.bincount(y))[:-1] / len(y)
    t = np.log(below / (1 - below))
    step_w, step_t = np.full(len(w), 1e-8), np.full(len(t), 1e-8)
    for _ in range(rounds):
        _, gw, gt = loss(w, t, row, at, scale, y)
        step_w += gw**2
        step_t += gt**2
        w -= RATE * gw / np.sqrt(step_w)
        t = np.maximum.accumulate(t - RATE * gt / np.sqrt(step_t))
    return Model(tuple(int(x) for x in levels), dict(zip(useful.tolist(), w.tolist(), strict=True)), t)


COMMON = 50  # documents of the sample beyond which a feature doesn't tell copies


def _counts(docs: list[np.ndarray]) -> np.ndarray:
    """How many documents have each feature."""
    n = np.zeros(1 << BITS, np.int32)
    for d in docs:
        n[d] += 1
    return n


def _first_of_copies(docs: list[np.ndarray]) -> np.ndarray:
    """Places of the documents (distinct features each) without near copies of earlier ones: those that share their lowest hash of rare features."""
    count = _counts(docs)
    mixed = lambda r: r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    lowest = [min(mixed(d[count[d] <= COMMON]).tolist(), default=-1 - i) for i, d in enumerate(docs)]
    return np.sort(np.unique(lowest, return_index=True)[1])


def _useful(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """A flag for each feature that enough documents (distinct features each) have and for which the share of grades above
    some threshold differs from that of all by more than chance."""
    n = _counts(docs)
    useful = np.zeros(1 << BITS, bool)
    for k in range(y.max()):
        above = y > k
        off = above - above.mean()
        total = np.zeros(1 << BITS, np.float32)
        for d, x in zip(docs, off, strict=True):
            total[d] += np.float32(x)
        useful |= np.abs(total) >= np.maximum(np.float32(LEAST_Z * above.std()) * np.sqrt(n), np.float32(LEAST_OFF) * n)
    return useful & (n >= LEAST_DOCS)


def fit(rated: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from rated (doc_id, text, grade), null grades left out; None if fewer than two grades are rated."""

    def run(batches):
        for b in batches:
            rows = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "grade", "features"])

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        """The sample is bounded, so one task fits it; only what the model kept comes back."""
        rows = rows.sort_values(["doc_id", "grade", "features"])[:sample]
        m = fit_rows(rows["grade"].to_numpy(), [np.frombuffer(x, np.int32) for x in rows["features"]])
        if m is None:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("grades", "features", "weights", "thresholds")})
        return pd.DataFrame({"grades": [list(m.grades)], "features": [list(m.weights)], "weights": [list(m.weights.values())], "thresholds": [m.thresholds.tolist()]})

    small_batches(rated.sparkSession)
    d = rated.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.col("grade").cast("int"))
    rows = d.mapInArrow(run, "doc_id long, grade int, features binary").withColumn("all", F.lit(0)).groupBy("all")
    found = rows.applyInPandas(fitted, "grades array<int>, features array<int>, weights array<double>, thresholds array<double>").first()
    if found is None:
        return None
    return Model(tuple(found["grades"]), dict(zip(found["features"], found["weights"], strict=True)), np.array(found["thresholds"]))


def rated_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, grade, text) of the `sample` labelled documents whose hash is lowest; of an id's texts the one of lowest hash.

    Grades: 0 for low quality, 1 for good but toxic, 2 for good. The labels sampled are broadcast; their number is bounded.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    some = labels.select(F.col("doc_id").alias("id"), grade.alias("grade")).filter("grade is not null and id is not null").distinct()
    some = lowest(some, sample)
    d = docs.select("doc_id", "text")
    d = d.join(F.broadcast(some), d["doc_id"] == some["id"]).select("doc_id", "grade", F.coalesce("text", F.lit("")).alias("text"))
    return d.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


class _Words(dict):
    """What the features of each word weigh, as the model's weigh() has it."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> complex:
        v = self.model.weigh(word_features(word))
        if len(word) <= 64:
            if len(self) >= _REMEMBERED:
                self.clear()
            self[word] = v
        return v


def graded(docs: DataFrame, model: Model | None, least: float = KEEP) -> DataFrame:
    """Each row of docs (text, others) as the struct column `doc`, with expected_grade, tail and keep.

    tail is the probability of the best grade. keep: tail is at least `least`; where the model gives a document without
    evidence less than that, as when few of the rated ones are good, that is the bound, so that such documents stay.
    Null text is empty; without a model expected_grade is null, tail 1 and keep true; repeated rows come back each; empty
    table: no rows.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    if model is None:
        return d.withColumn("expected_grade", F.lit(None).cast("double")).withColumn("tail", F.lit(1.0)).withColumn("keep", F.lit(True))
    small_batches(docs.sparkSession)
    shared, cut = docs.sparkSession.sparkContext.broadcast(model), model.cut(least)

    def run(batches):
        m = shared.value
        known = _Words(m)
        for b in batches:
            texts = b.column(0).field("text")
            score = np.empty(b.num_rows)
            for i in range(b.num_rows):
                words = (texts[i].as_py() or "").split()
                distinct = set(words)
                score[i] = score_of(sum(map(known.__getitem__, sorted(distinct)), m.weigh([shape_feature(len(words), len(distinct))])))
            tail = m.tails(score)[:, -1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.expected(score)), pa.array(tail), pa.array(tail >= cut)], ["doc", "expected_grade", "tail", "keep"])

    return d.mapInArrow(run, f"doc {d.schema['doc'].dataType.simpleString()}, expected_grade double, tail double, keep boolean")


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return graded(docs, fit(rated_sample(docs, labels, sample), sample))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select(F.col("doc.doc_id").alias("doc_id"), "expected_grade", "tail", "keep")
