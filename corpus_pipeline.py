"""Training-corpus pipeline: quality classifier, exact de-duplication, near
de-duplication (five-word shingles, similarity 0.8), mixing of the sources,
BPE encoding. Every stage works on all rows that the one before it kept.

Null texts count as empty in every stage, null languages and sources are
values of their own. Rows without doc_id are kept and de-duplicated like any
other; of equal texts the largest doc_id stays, of near copies the smallest,
and a null loses against any number. Repeated rows (one doc_id and text) are
copies. Columns beyond doc_id, text, lang, source and n_chars are carried
along whatever their names; the last stage returns doc_id, n_tokens and ids. An
empty table gives an empty result; without usable labels the classifier
accepts all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from histospark.llm import bpe, exact_dedup, mixing, ngram_join, quality_classifier
from histospark.llm.common import settle, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is fitted on ``labels``."""
    settle(spark)
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (the largest doc_id)."""
    settle(spark)
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the smallest doc_id)."""
    settle(spark)
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a document once per round in which it is taken, cut
    where its source's target ends inside it, in the order of the schedule."""
    settle(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document of the mix."""
    settle(spark)
    return bpe.encode(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mix_sources", mix), ("bpe", encode)]

#: The classifier can't be expressed in SQL; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
