"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's documents.

Stages judge texts, so nulls in other columns, ids that are null or shared, repeated rows and further columns of any name change nothing
and stay. Null and empty texts are neither bad nor toxic nor leaks; as near copies of each other one of them stays; mixing takes it by its
source's rate. Very long texts are read whole; empty tables give empty ones. Each operator's docstring has its own cases.

All stages but the last return the columns of `documents`. Stages don't see each other's lineage, so a lost executor repeats
work of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotelark.llm import op2_substring_dedup, op5_quality, op6_jaccard, op9_decontamination, op10_mixing
from quotelark.llm.common import cut, held, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the nearest labelled neighbours vote down; learns from the training fold of `labels`."""
    labels = table(spark, sf_dir, "labels").where(~held("doc_id", 5, 0))
    return op5_quality.decide(docs, op5_quality.fit(docs, labels))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return op6_jaccard.deduplicate(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that an earlier document has out of all later ones."""
    return op2_substring_dedup.remove_repeats(docs)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return op9_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until each source's words come near its target; `copy` numbers a document's copies."""
    return op10_mixing.copies_of(op10_mixing.mix(docs))


STAGES = [
    ("quality", good_quality),
    ("near_copies", one_of_each_class),
    ("repeated_passages", no_repeated_passages),
    ("decontamination", no_test_items),
    ("mixing", mixed),
]

#: SQL can't express the classifier, the joins on similarity or edit distances; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
