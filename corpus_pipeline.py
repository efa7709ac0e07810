"""A corpus pipeline of five stages: quality rules, near copies, secrets, mixing and packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from sonarium.llm.common import table, written
from sonarium.llm.mixing import draw_mix
from sonarium.llm.near_dups import without_near_duplicates
from sonarium.llm.packing import pack_documents
from sonarium.llm.quality import keep_good
from sonarium.llm.queries import TOKENIZER
from sonarium.llm.secrets import remove_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8 or more)."""
    return without_near_duplicates(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return remove_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as long, as the mix of sources takes them."""
    return draw_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences."""
    return pack_documents(docs, TOKENIZER, added=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The stages draw on hashes, learned models and a tokenizer that SQL cannot express; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again."""
    *stages, last = STAGES
    docs = reduce(lambda d, s: written(s[1](spark, d, sf_dir), s[0]), stages, table(spark, sf_dir, "documents"))
    return last[1](spark, docs, sf_dir)
