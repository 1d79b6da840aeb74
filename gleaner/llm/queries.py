"""The operators of this package as queries over whole tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import alignment, ball_search, fingerprints, hard_negatives, language_id, mixing, multi_index, ngram_join, packing, pii, quality, sql, token_store, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, bundles = language_id.prototypes(docs.filter(~language_id.held_out("doc_id", 3, 1)))
    return language_id.predict(docs, names, bundles).select("doc_id", language_id.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), spaces="dropped", end_id=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), spaces="leading", end_id=0)
    found = token_store.read(spark, folder, docs.select("doc_id"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), similarity=0.93)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, model = quality.fit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~language_id.held_out("doc_id", 5, 0))
    return quality.scored(stats, model, threshold=0.3).select("doc_id", language_id.held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op8_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"), similarity=0.8, width=5)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the groups' text of a corpus is several times the corpus, so it is digested where it is made
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, every=100, positives=5, negatives=10, share=(30, 90, 100), scale=256)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"), idf=(1.0, 10.0))


QUERIES = [
    op1_language_id, op2_packing, op3_token_store, op4_warc, op5_pii, op6_multi_index, op7_quality, op8_ball_search,
    op9_ngram_jaccard_join, op10_mixing, op11_alignment, op12_hard_negatives,
    op13_fingerprints,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
