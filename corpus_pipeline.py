"""From raw documents to encoded training rows: five stages, each an operator of tidemark.llm.

Every stage takes all rows that the one before kept. All but the last return the columns of documents; the last returns
one row a document with its token ids. Null and empty texts pass every stage but the classifier, which judges them by their
statistics; rows without a doc_id are no copies and lose nothing; repeated rows are near copies of one another, of which one
stays; texts are of any length; no documents give no rows; other columns go through to the mixing unchanged, and those of the
operators' own names (score, bucket) too, but for names that begin with mix_, which the mixing leaves out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import byte_bpe, read_ranks
from tidemark.llm.common import staged, table
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.near import keep_one
from tidemark.llm.quality import keep_good
from tidemark.llm.repeats import suffix_dedup


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that also start in an earlier one; emptied ones stay, empty."""
    return suffix_dedup(docs, with_text=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows taken by the source weights: a row for each epoch, whole documents."""
    return mixed_rows(docs).select(*[c for c in docs.columns if not c.lower().startswith("mix_")])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the checksums of ids and decoded text."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe(docs, ranks, public_tokenizers.PATTERN).drop("decoded")


STAGES = [
    ("quality classifier", drop_poor),
    ("near-duplicates", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("source mixing", mix),
    ("byte-level BPE", encode),
]

#: The classifier, the signatures and the merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stage's rows written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
