"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Documents that the quality classifier rejects go; of each near-duplicate group the first document stays; secrets are
masked; sources are mixed to their target weights, which repeats and leaves out documents; what remains is encoded.

Every stage takes a table with the columns of documents (doc_id, text, source; others are carried along, whatever their
names) and, but for the last, returns the same columns. Any column may be null; null and empty texts are told apart in
what is returned only; texts are read whole, however long; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subsieve.llm import bpe, mixing, nearcopies, quality, secrets
from subsieve.llm.common import materialize, table, temporary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is at least the model's cut.

    The model is fitted on a bounded sample of the rated documents that are in docs; without two rated grades all rows
    stay. Null text counts as empty, has no evidence and stays; repeated rows stay or go together.
    """
    d = quality.classified(docs, table(spark, sf_dir, "labels"))
    return d.filter("keep").select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, Jaccard similarity 0.8), by doc_id.

    Rows with a null id are left to others of their group; texts without words are each other's copies; of repeated rows
    (id and text) one stays; two texts under one id are two documents.
    """
    return nearcopies.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced; null text stays null, n_chars follows, repeated rows stay."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, cut where its source's budget ends.

    Null source is one more source, last in order. Documents without words, null text among them, take nothing and go.
    Repeated rows are documents of their own.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each row's token ids, and of the text decoded from them; null text has no ids."""
    return bpe.digests(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("secrets", masked), ("mixing", mixed), ("bpe", encoded)]

#: Trained models and similarities have no SQL form; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over documents; what a stage writes on its way is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            docs = materialize(out, name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
