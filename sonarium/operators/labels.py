"""Label predictions and their distribution over a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.functions.labels import probability_map, softmax, top_label


def predict_labels(df: DataFrame, logits: str, id2label: Sequence[str], error: str | None = None) -> DataFrame:
    """Adds ``probabilities`` (map), ``predicted_label``, ``confidence``, ``fallback`` and ``error``.

    A row without logits, or with a text in the column ``error``, gets the fallback; its error is that text, else "no logits".
    """
    told = F.col(error) if error else F.lit(None).cast("string")
    failed = F.col(logits).isNull() | (F.size(logits) == 0) | told.isNotNull()
    probs = F.when(~failed, softmax(F.col(logits)))
    return (
        df.withColumn("_p", probs)
        .withColumns(
            {
                "predicted_label": F.when(failed, F.lit("unknown")).otherwise(top_label(F.col("_p"), id2label)),
                "probabilities": F.when(failed, F.create_map(F.lit("unknown"), F.lit(1.0))).otherwise(
                    probability_map(F.col("_p"), id2label)
                ),
                "confidence": F.when(failed, F.lit(0.0)).otherwise(F.array_max("_p")),
                "fallback": failed,
                "error": F.when(failed, F.coalesce(told, F.lit("no logits"))),
            }
        )
        .drop("_p")
    )


def ranked_probabilities(df: DataFrame, probabilities: str = "probabilities", predicted: str = "predicted_label") -> DataFrame:
    """One row per label, most probable first (ties by label); sorted inside the row, without a shuffle."""
    entries = F.array_sort(
        F.map_entries(F.col(probabilities)),
        lambda a, b: F.when(a["value"] > b["value"], -1)
        .when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1)
        .when(a["key"] > b["key"], 1)
        .otherwise(0),
    )
    kept = [c for c in df.columns if c != probabilities]
    return (
        df.select(*kept, F.posexplode(entries).alias("_i", "_e"))
        .withColumns(
            {
                "rank": F.col("_i") + 1,
                "label": F.col("_e.key"),
                "probability": F.col("_e.value"),
                "is_predicted": F.col("_e.key") == F.col(predicted),
            }
        )
        .drop("_i", "_e")
    )


def label_counts(df: DataFrame, label: str, order: str) -> DataFrame:
    """(label, count, first seen); map-side combined."""
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("first_seen")
    )


def label_distribution(counts: DataFrame) -> DataFrame:
    """Share of each label among all predictions."""
    total = counts.agg(F.struct(F.sum("count").alias("n"), F.min("first_seen").alias("first")))
    return counts.select("label", "count", (F.col("count") / total.scalar()["n"]).alias("share"))


def dominant_label(counts: DataFrame) -> DataFrame:
    """The label with most predictions; the one seen first wins ties."""
    total = counts.agg(F.struct(F.sum("count").alias("n"), F.min("first_seen").alias("first")))
    return (
        counts.orderBy(F.desc("count"), F.asc("first_seen"))
        .limit(1)
        .select("label", "count", (F.col("count") / total.scalar()["n"]).alias("share"))
    )


def hit_counters(df: DataFrame, hit: str) -> DataFrame:
    """Hits, misses and hit rate (0 without requests)."""
    hits, total = F.count_if(F.col(hit)), F.count(F.lit(1))
    return df.agg(
        hits.alias("hits"),
        (total - hits).alias("misses"),
        F.when(total == 0, 0.0).otherwise(hits / total).alias("hit_rate"),
    )
