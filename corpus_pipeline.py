"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the rows its predecessor kept and is written as Parquet before the next one
reads them.  The classifier and the vocabulary put the whole beyond SQL, so there is no oracle.
``tests/llm/test_pipeline.py`` holds every stage against its operator, and what follows the trained
classifier (groups, mix, pieces and their places) against plain code on the whole table; the rules
and the classifier have plain versions in the tests of their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lecturelake.llm import mixing, packing, quality_classifier, quality_rules, simhash
from lecturelake.llm.common import materialize, table
from lecturelake.llm.queries import LABELLED_ROWS, SEQUENCE_IDS
from lecturelake.llm.tokens import vocabulary

ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.select(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likely enough."""
    labels = table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", quality_classifier.grade(labels["quality"], labels["toxic"]).alias("grade"))
    return quality_classifier.select(docs, ratings, rated_rows=LABELLED_ROWS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, vocabulary(), SEQUENCE_IDS)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", near_dedup),
    ("source_mix", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
