"""Corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import decontaminate, minhash, mixing, quality, secret_scan
from shelfline.llm.common import table
from shelfline.session import stash


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.dedup(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secret_scan.clean(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document: its size, its source's size and target, its copies in the mix and the words they take."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", distinct_documents),
    ("decontamination", unseen_documents),
    ("secret scan", redacted_documents),
    ("source mixing", mixture),
]

ORACLE_SQL = None  # classifier scores, MinHash signatures and random rounding have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
