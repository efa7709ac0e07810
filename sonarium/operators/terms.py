"""Cohort term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from sonarium.functions.fixed import STOP_WORDS, TOKEN_STRIP
from sonarium.functions.text import count_words, words


def non_blank(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def term_tokens(df: DataFrame, text: str = "text", file: str = "doc_id") -> DataFrame:
    """One row per kept token: (file, pos, term). Filters run after the explode, in generated code."""
    tokens = df.filter(non_blank(F.col(text))).select(
        F.col(file), F.posexplode(words(F.lower(F.col(text)))).alias("pos", "raw")
    )
    term = F.lower(F.btrim(F.col("raw"), F.lit(TOKEN_STRIP)))
    return (
        tokens.select(file, "pos", term.alias("term"))
        .filter(F.length("term") > 2)
        .filter(~F.col("term").isin(STOP_WORDS))
    )


def term_counts(tokens: DataFrame, file: str = "doc_id") -> DataFrame:
    """(term, count, first seen place); combined on the map side, so a hot term costs one row per task.

    With whole-number files the place is one number, which a hash aggregation can hold; a struct would have every task sort
    its tokens first.
    """
    if tokens.schema[file].dataType in (IntegerType(), LongType()):
        place = F.col(file).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("pos")
    else:
        place = F.struct(F.col(file), F.col("pos"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("first_seen"))


def top_terms(counts: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent terms with their percentage; equal counts keep first-seen order."""
    # the subquery asks for the same columns, so that it reads the shuffle the counts already made
    total = counts.agg(F.struct(F.sum("count").alias("n"), F.min("first_seen").alias("first")))
    return (
        counts.orderBy(F.desc("count"), F.asc("first_seen"))
        .limit(k)
        .select("term", "count", (F.lit(100.0) * F.col("count") / total.scalar()["n"]).alias("percentage"))
    )


def word_counts(df: DataFrame, text: str = "text", file: str = "doc_id") -> DataFrame:
    """Tokens per non-empty transcript, before any filter."""
    return df.filter(non_blank(F.col(text))).select(file, count_words(F.col(text)).cast("long").alias("word_count"))


def term_summary(df: DataFrame, text: str = "text", file: str = "doc_id") -> DataFrame:
    """One row: files, filtered words, unique filtered words, mean unfiltered words per file."""
    kept = term_counts(term_tokens(df, text, file), file).agg(
        F.struct(F.coalesce(F.sum("count"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("u")).alias("s")
    )
    files = word_counts(df, text, file).agg(
        F.count(F.lit(1)).alias("total_files"), F.avg("word_count").alias("avg_words_per_file")
    )
    return files.withColumn("_k", kept.scalar()).select(
        "total_files",
        F.col("_k.w").alias("total_words"),
        F.col("_k.u").alias("unique_words"),
        "avg_words_per_file",
    )
