"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import packing, pii, quality_classifier, quality_rules, wide_simhash
from sievewright.llm.shared import table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on what is left, does not reject."""
    params = quality_classifier.Params()
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), params)
    return quality_classifier.keep(docs, model, params.threshold)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, similar by 0.8 over five-word shingles, the document of the smallest id."""
    return wide_simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]

#: A trained classifier and best-fit search have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
