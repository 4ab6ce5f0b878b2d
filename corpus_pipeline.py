"""A training-data pipeline over ``documents``: quality, exact and near duplicates, mix, tokens.

Each stage works on all that the one before it kept, written as Parquet and read again.

Defined results of every stage: null texts count as empty ones; an empty text is scored like any
other, equals other empty texts, is near no other document and has no place in the mix, which is
made of words; texts of any length are read whole; rows that repeat an id are documents of their
own, of rows alike in all columns one stays; null ids and sources are values like others; further
columns are kept, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from netloom.llm.common import shared_dir
from netloom.llm.queries import MULTI, PATTERN
from netloom.session import ship


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, the one with the largest id."""
    return exact_dedup.kept(docs)


#: Documents whose 5-word shingle sets have a Jaccard similarity of so many hundredths are near copies.
NEAR_PERCENT = 80


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each near-duplicate group, the one with the smallest id."""
    ship(spark)
    return near_dedup.kept(docs, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at their sources' target weights; one that is read twice is there twice."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    ship(spark)
    return bpe.round_trip(docs, MULTI, PATTERN)


STAGES = [("quality", classify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix), ("tokens", tokenize)]

#: Boosted trees, near-duplicate components and byte-pair encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
