"""Transcript accuracy against ground truth; one output row per input row, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.text import (
    clean_text,
    count_words,
    error_rate,
    far_distance,
    near_char_distance,
    near_word_distance,
    text_ratio,
    word_ratio,
    words,
)

METRICS = (
    "accuracy_percentage",
    "word_error_rate",
    "character_error_rate",
    "levenshtein_distance",
    "exact_match",
    "character_similarity",
    "word_count_predicted",
    "word_count_truth",
)


def with_cleaned(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Adds the cleaned texts and their words; both null where there is no truth."""
    known = F.col(truth).isNotNull() & (F.col(truth) != "")
    return df.withColumns(
        {
            "_p": F.when(known, clean_text(F.coalesce(F.col(predicted), F.lit("")))),
            "_t": F.when(known, clean_text(F.col(truth))),
        }
    ).withColumns({"_pw": words(F.col("_p")), "_tw": words(F.col("_t"))})


def with_distance(df: DataFrame, a: str, b: str, out: str, near: Callable[[Column, Column], Column]) -> DataFrame:
    """Edit distance of two columns: on the JVM where ``near`` settles it, in a bit-parallel Arrow helper for the rest.

    The helper gets nulls for settled rows, so only long and differing pairs travel to Python.
    """
    near_done = df.withColumn("_near", near(F.col(a), F.col(b)).cast("long"))
    open_pair = F.col("_near").isNull()
    far = far_distance(F.when(open_pair, F.col(a)), F.when(open_pair, F.col(b)))
    return near_done.withColumn(out, F.coalesce("_near", far).cast("int")).drop("_near")


def transcript_accuracy(
    df: DataFrame, predicted: str = "predicted", truth: str = "truth", metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Adds the asked metrics. Without truth every metric is null, the predicted count is of raw words, the truth count 0.

    ``accuracy_percentage`` and ``character_similarity`` send every text to a Python worker, the distances only long ones.
    """
    forms = {
        "accuracy_percentage": lambda: word_ratio("_p", "_t") * 100,
        "word_error_rate": lambda: F.when(
            F.col("_t").isNotNull(),
            error_rate(F.col("_wd"), F.size("_tw"), F.size("_pw")),
        ),
        "character_error_rate": lambda: F.when(
            F.col("_t").isNotNull(),
            error_rate(F.col("levenshtein_distance"), F.length("_t"), F.length("_p")),
        ),
        "exact_match": lambda: (F.col("_p") == F.col("_t")).cast("double"),
        "character_similarity": lambda: text_ratio("_p", "_t") * 100,
        "word_count_predicted": lambda: F.when(F.col("_t").isNotNull(), F.size("_pw")).otherwise(
            count_words(F.col(predicted))
        ),
        "word_count_truth": lambda: F.when(F.col("_t").isNotNull(), F.size("_tw")).otherwise(F.lit(0)),
    }
    asked = set(metrics)
    unknown = asked - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    scored = with_cleaned(df, predicted, truth)
    if asked & {"levenshtein_distance", "character_error_rate"}:
        scored = with_distance(scored, "_p", "_t", "levenshtein_distance", near_char_distance)
    if "word_error_rate" in asked:
        scored = with_distance(scored, "_pw", "_tw", "_wd", near_word_distance)
    rest = {m: forms[m]() for m in METRICS if m in asked and m != "levenshtein_distance"}
    scored = scored.withColumns(rest) if rest else scored
    dropped = ["_p", "_t", "_pw", "_tw", "_wd"] + ([] if "levenshtein_distance" in asked else ["levenshtein_distance"])
    return scored.drop(*dropped)


def mean_accuracy(scored: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per group; rows without truth are left out of the means."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), *[F.avg(m).alias(f"avg_{m}") for m in metrics]
    )
