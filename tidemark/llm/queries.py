"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import aligned
from tidemark.llm.audio import audio_features
from tidemark.llm.byte_bpe import byte_bpe, read_ranks
from tidemark.llm.common import table
from tidemark.llm.inner_products import top_inner_products
from tidemark.llm.licenses import license_scan, scan_sql
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.near import near_duplicates
from tidemark.llm.quality import quality
from tidemark.llm.repeats import suffix_dedup
from tidemark.llm.rules import quality_rules, rules_sql
from tidemark.llm.token_counts import token_counts
from tidemark.llm.toxicity import toxicity
from tidemark.llm.turns import damaged, repair_sql, repaired_conversations

RANK_FILE, TOKENIZER_FILE, PIECE_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


@cache
def _tokenizer_json() -> str:
    with open(public_tokenizers.path(TOKENIZER_FILE), encoding="utf-8") as file:
        return file.read()


@cache
def _piece_model() -> bytes:
    with open(public_tokenizers.path(PIECE_FILE), "rb") as file:
        return file.read()


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_block_place").alias("block_place"), F.col("mix_row_place").alias("row_place"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_inner_products(vectors, vectors.where("vec_id % 50 = 0"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(RANK_FILE))
    out = byte_bpe(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer_json(), public_tokenizers.PATTERN)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), _tokenizer_json(), _piece_model())


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_audio_features, op2_suffix_dedup, op3_mixing, op4_toxicity, op5_inner_products, op6_byte_bpe, op7_near_duplicates, op8_license_scan, op9_quality, op10_token_counts,
        op11_quality_rules, op12_alignment, op13_conversation_repair,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_inner_products": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_license_scan": scan_sql(),
    "op11_quality_rules": rules_sql(),
    "op13_conversation_repair": repair_sql(),
}
