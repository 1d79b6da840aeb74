"""The corpus pipeline: documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import mixing, ngram_join, packing, pii, quality
from gleaner.llm.storage import bounded_batches, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    bounded_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return ngram_join.keep_one(docs, similarity=0.8, width=5)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind."""
    bounded_batches(spark)
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: pieces of documents, repeated or left out as the mix has drawn them."""
    bounded_batches(spark)
    return mixing.mix(docs, weights=(1, 2, 3), most=3.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their token ids."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), spaces="dropped", end_id=2, window=4096)


STAGES = [("quality", keep_good), ("near_duplicates", deduplicate), ("personal_data", redact), ("mix", mix), ("pack", pack)]

#: Fitted models and pseudorandom draws are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
