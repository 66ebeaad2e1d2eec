"""A corpus pipeline of training-data operators, one stage after the other.

Each stage takes all documents that the one before kept, as stored, and
returns documents (the last one token pieces with their places).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thetaflow.llm import decontaminate, line_dedup, ngram_join, packing, quality
from thetaflow.llm.common import stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or place has, up to few edits; those left without words go."""
    return line_dedup.dedup(docs, drop_emptied=True)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("line dedup", unique_lines),
    ("near duplicates", unique_documents),
    ("decontaminate", decontaminated),
    ("pack", packed),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is stored in the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
