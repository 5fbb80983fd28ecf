"""A training corpus from raw documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookloom.llm import exact_dedup, near_dedup, packing, quality_classifier, toxicity
from bookloom.llm.common import materialise, modest_batches


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    modest_batches(spark)
    return quality_classifier.keep(docs, quality_classifier.train(docs, _labels(spark, sf_dir)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    modest_batches(spark)
    return toxicity.keep(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    modest_batches(spark)
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    modest_batches(spark)
    return near_dedup.keep(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    modest_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]
#: SQL can express neither trained classifiers nor the search for near copies; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
