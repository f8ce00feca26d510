"""Corpus pipeline over documents; each stage works on all its predecessor kept.

Every stage but the last returns the columns of documents. Documents that break a
quality rule go; of each group of near copies one stays; personal data is replaced
by tags; sources are mixed to target weights, with a row for each copy that is
taken; the last stage encodes what is left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrove.llm import bpe, mixing, pii, quality, simhash
from cellgrove.llm.catalog import WORD_BPE, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.report(docs, tokenizer_file(WORD_BPE))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("encode", encode),
]
#: Near copies and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, as the stages expect."""
    from cellgrove.session import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if n + 1 < len(STAGES) else docs
    return docs
