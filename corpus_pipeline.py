"""The corpus pipeline: language, near duplicates, benchmark passages, secrets, mixture.

``STAGES`` are applied in order; each works on all documents that its predecessor kept, and all but the last return the
columns of documents. Each bounds its own batches to Python, also when it is called without ``run``. Documents of
unknown language go, one of each group of similar documents stays, documents with a benchmark passage go, secrets are
blotted out of the texts, and the mixture tells how many words of each it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, language, mixing, secrets, similar
from waymark.llm.registry import bounded_batches, table
from waymark.session import cut_lineage, prepare

ORACLE_SQL = None  # language and sampled paths have no SQL; tests/llm holds the stages against brute force


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the context trees know."""
    bounded_batches(spark, 4 << 20)  # a batch holds its texts twice, and workers hold the context trees
    return language.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 and more."""
    bounded_batches(spark)
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    bounded_batches(spark)
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blotted out."""
    bounded_batches(spark)
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of each document."""
    bounded_batches(spark)
    return mixing.mix(docs)


STAGES = [
    ("language", languages), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before has written."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
