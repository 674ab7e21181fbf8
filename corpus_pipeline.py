"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Quality and decontamination drop documents, the n-gram join keeps one document of each group of near
duplicates, the PII stage replaces what it finds, and the last stage adds token ids.  Every stage takes
(spark, docs, sf_dir) and passes on the columns of documents; a stage is right on any input, empty
tables and null texts included, as its operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymast.llm import decontaminate, ngram_jaccard, pii, quality, sentencepiece
from tallymast.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return ngram_jaccard.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return sentencepiece.tokenize(docs)


STAGES = [("quality", good), ("ngram_jaccard", distinct), ("decontamination", clean), ("pii", private), ("sentencepiece", tokens)]

#: SQL can fit no trees; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
