"""Training-data pipeline over ``documents``: each stage is one of the operators.

``run`` applies the stages one after the other; every stage's result is written as a
table that the next one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortpulse.llm import common, grace, mixing, packing, quality, simhash, tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows, does not reject."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, with all its columns."""
    return grace.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays: documents whose
    fingerprints of four-word shingles link within 4 bits."""
    return simhash.drop_near(docs, simhash.SHINGLE, simhash.RADIUS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in mixture order; those of small sources come up to one and a half
    times, and every document at least once."""
    return mixing.mixed(docs, tokens.vocabulary_path(), most_passes=mixing.PASSES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts and their places in windows of tokens."""
    return packing.pack(docs, tokens.vocabulary_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages train a model, link components and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
