"""Numeric feature profiles of a cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sonarium.functions.rows import category_list
from sonarium.operators.blocks import attach_small, order_stats
from sonarium.session import settle


def flatten_features(df: DataFrame, column: str) -> DataFrame:
    """Nested structs become ``outer_inner`` columns; plain numbers keep their name."""
    out: list[Column] = [F.col(c) for c in df.columns if c != column]
    for field in df.schema[column].dataType.fields:
        if isinstance(field.dataType, StructType):
            out += [F.col(f"{column}.{field.name}.{sub}").alias(f"{field.name}_{sub}") for sub in field.dataType.names]
        else:
            out.append(F.col(f"{column}.{field.name}"))
    return df.select(*out)


def melt(df: DataFrame, file: str, features: Sequence[str] | str) -> DataFrame:
    """Long form (file, feature, value) from columns or from one map column; missing values are left out."""
    if isinstance(features, str):
        long = df.select(file, F.explode(features).alias("feature", "value"))
    else:
        long = df.select(file, *[F.col(c).cast("double") for c in features]).unpivot(
            file, list(features), "feature", "value"
        )
    return long.filter(F.col("value").isNotNull())


def feature_stats(long: DataFrame, median: bool = True) -> DataFrame:
    """count, mean, population std, min and max per feature, and the exact median, which takes a second pass over the rows."""
    v = F.col("value")
    plain = {"n": F.count(v), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}
    if not median:
        return long.groupBy("feature").agg(*[c.alias(n) for n, c in plain.items()])
    return order_stats(long, ["feature"], "value", {"median": ("linear", 0.5)}, **plain)


def histogram(long: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max] per feature, the right edge in the last bin; empty bins are kept.

    A feature with one value gets the range value ± 0.5. Rows are reduced to (feature, bin) counts before the shuffle.
    """
    ranges = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ranges = settle(ranges.select(
        "feature",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    ))
    width = (F.col("_hi") - F.col("_lo")) / bins
    # the edges decide, not the division: a value on an edge belongs to the bin that begins there
    near = F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    low, high = F.col("_lo") + F.col("bin") * width, F.col("_lo") + (F.col("bin") + 1) * width
    exact = (
        F.when((F.col("bin") > 0) & (F.col("value") < low), F.col("bin") - 1)
        .when((F.col("bin") < bins - 1) & (F.col("value") >= high), F.col("bin") + 1)
        .otherwise(F.col("bin"))
    )
    placed = attach_small(long, ranges, ["feature"], settled=True).withColumn("bin", near).select("feature", exact.alias("bin"))
    counts = placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
        F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def prevalence_rank(stats: DataFrame, k: int = 10) -> DataFrame:
    """Features that are both high in their range and stable; ties by name."""
    span = F.col("max") - F.col("min")
    scored = (
        stats.filter(span > 0)
        .withColumn("normalized_mean", (F.col("mean") - F.col("min")) / span)
        .withColumn(
            "stability_score",
            F.when(F.col("mean") == 0, 1.0).otherwise(1.0 / (1.0 + F.col("std") / F.abs("mean"))),
        )
        .withColumn("prevalence_score", F.col("normalized_mean") * F.col("stability_score"))
    )
    return (
        scored.orderBy(F.desc("prevalence_score"), F.asc("feature"))
        .limit(k)
        .select("feature", "normalized_mean", "stability_score", "prevalence_score", "mean", "std")
    )


def categorise(features: DataFrame) -> DataFrame:
    """(category, feature) pairs; a feature may belong to several categories."""
    return features.select(F.explode(category_list(F.col("feature"))).alias("category"), "feature").distinct()


def profile_summary(long: DataFrame, file: str) -> DataFrame:
    """Files, features, mean duration and mean tempo (0 where absent)."""
    per_feature = long.groupBy("feature").agg(F.avg("value").alias("m"))
    by_feature = per_feature.agg(
        F.struct(
            F.count(F.lit(1)).alias("features"),
            F.coalesce(F.max(F.when(F.col("feature") == "duration", F.col("m"))), F.lit(0.0)).alias("duration"),
            F.coalesce(F.max(F.when(F.col("feature") == "tempo", F.col("m"))), F.lit(0.0)).alias("tempo"),
        )
    )
    files = long.select(file).distinct().agg(F.count(F.lit(1)).alias("total_files"))
    return files.withColumn("_s", by_feature.scalar()).select(
        "total_files",
        F.col("_s.features").alias("total_features_extracted"),
        F.col("_s.duration").alias("avg_duration"),
        F.col("_s.tempo").alias("avg_tempo"),
    )


def as_feature_map(columns: Mapping[str, Column]) -> Column:
    """Map of the non-null features of a row."""
    full = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c.cast("double"))])
    return F.map_filter(full, lambda _, v: v.isNotNull())
