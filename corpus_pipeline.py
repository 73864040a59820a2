"""From raw documents to token ids: each stage's rows are written and read again as the next stage's documents.

Defined results: null and empty texts go in the first stage, as they have too few words; texts of any length are read
whole; of repeated rows, exact copies and ties one is left, that of the least doc_id (nulls last); nulls in other columns
pass, and count as other values where documents are sampled; further columns, whatever their names, pass untouched, and
columns of token ids whose names are taken get a leading ``_``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from indexloom.llm import bpe, chunks, mixing, neardup, quality
from indexloom.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule turns down."""
    return quality.filter_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that an earlier document has."""
    return chunks.drop_repeated_chunks(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target weights of sources, languages and topics."""
    return mixing.sample_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encode_stage),
]

#: SQL cannot express the near-duplicate and encoding stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each stage's rows are cut from what made them in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
