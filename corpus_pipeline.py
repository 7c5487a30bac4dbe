"""A corpus pipeline of the training-data operators: each stage works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import decontaminate, exact_dedup, language_id, minhash_dedup, source_mix
from sparkquarry.llm.tables import cut, load, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose letters don't read like those of any labelled language.

    Null and empty texts have no letter and go; mixed languages near a tie stay; rows that repeat an id stay
    or go together; without any lang every text with a letter stays.
    """
    return language_id.keep_identified(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; a null text equals an empty one, of rows equal in id and text one stays, a null id is never preferred."""
    return exact_dedup.drop_duplicates(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest id (five words, similarity 0.8).

    Texts without words and rows without an id have no near duplicates and stay; rows that repeat an id are one document.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none; rows that repeat an id go together."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, and taken, the words that the mix takes of it.

    Null and empty texts have size 0; a null source is one of its own; rows that repeat an id are separate documents.
    """
    return source_mix.mix(docs).withColumn("taken", F.col("size") * F.col("plays"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("decontaminate", remove_benchmark),
    ("source_mix", mix_sources),
]

#: The learned language model and the sketches have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), keep=True)
    return docs
