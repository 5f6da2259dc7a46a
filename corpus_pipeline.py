"""Corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is
written as Parquet and read back as the docs of the next one; all stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modalweave.llm import packing, pii, simhash, suffix, toxicity
from modalweave.llm.queries import read, tokenizer
from modalweave.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the rest stays as it is."""
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike (five-word shingles, similarity of 0.8 or more) one row with the least doc_id stays.

    SimHash classes (pivots, popcount) are searched first, bands of shingle minima bring what lies beyond three bits; shingle sets decide.
    """
    return simhash.keep_first(docs, simhash.similar_documents(docs))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document leave the text; the document stays, n_chars follows.

    A character cut by a seam is dropped with the passage it is part of.
    """
    return suffix.without_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes a mark with its kind; n_chars follows."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of every document."""
    return packing.pack_documents(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: The trained classifier has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
