"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._spark import documents, keep
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_dedup import unique_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality_filter
from tidemark.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose hosts do, go."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, and no other goes.

    Rows are judged by their own texts, whatever they share of ids; of rows that repeat wholly one stays.
    """
    return unique_documents(docs, shingle=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are struck out of the texts."""
    return redact_secrets(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents enter as often as their source's target asks for."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), forget=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_to_weights", mix_to_weights), ("pack", pack)]

#: SQL can't express near-duplicate components or packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else keep(docs), sf_dir)
    return docs
