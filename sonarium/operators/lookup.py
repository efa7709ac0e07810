"""Lookups of files in result and metadata tables, as equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.functions.fixed import LABEL_TRUTH_COLUMNS, TRUTH_COLUMNS, TRUTH_PREFIX
from sonarium.functions.rows import file_name


def batch_check(requested: DataFrame, results: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Every requested file with ``cached`` and its payload; files no result is known for count as missing."""
    held = results.select(F.col(key), F.col(payload), F.lit(True).alias("_held"))
    return (
        requested.join(held, key, "left")
        .withColumn("cached", F.coalesce("_held", F.lit(False)))
        .drop("_held")
    )


def cached_only(requested: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return requested.join(results.select(key), key, "left_semi")


def missing_only(requested: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return requested.join(results.select(key), key, "left_anti")


def cache_info(checked: DataFrame) -> DataFrame:
    """Cached and missing counts and hit rate over the requested files, 0 if none was requested."""
    hits = F.count_if(F.col("cached"))
    total = F.count(F.lit(1))
    return checked.agg(
        hits.alias("cached_count"),
        (total - hits).alias("missing_count"),
        F.when(total == 0, 0.0).otherwise(hits / total).alias("cache_hit_rate"),
    )


def _first_column(metadata: DataFrame, candidates: Sequence[str]):
    for name in candidates:
        if name in metadata.columns:
            return name
    return None


def attach_ground_truth(files: DataFrame, metadata: DataFrame, dataset: str, key: str = "filename", order: str = "row") -> DataFrame:
    """Add ``ground_truth`` from the dataset's metadata.

    The exact file name wins; for common-voice the name behind the dataset's folder prefix is the second choice. Both are
    one equi-join: every metadata row offers its name, and its name without the prefix at a lower rank. Of several rows the
    first counts. A null truth of a matched row becomes the text ``nan``, as reading the file gives it.
    """
    column = _first_column(metadata, TRUTH_COLUMNS.get(dataset, ()))
    if column is None:
        return files.withColumn("ground_truth", F.lit(None).cast("string"))
    offers = F.array(F.struct(F.lit(0).alias("rank"), F.col(key).alias("name")))
    if dataset == "common-voice":
        short = F.struct(F.lit(1).alias("rank"), F.expr(f"substring({key}, {len(TRUTH_PREFIX) + 1})").alias("name"))
        offers = F.when(F.col(key).startswith(TRUTH_PREFIX), F.concat(offers, F.array(short))).otherwise(offers)
    truth = (
        metadata.select(order, F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("_v"), F.inline(offers))
        .groupBy(F.col("name").alias(key))
        .agg(F.min_by("_v", F.struct("rank", order)).alias("ground_truth"))
    )
    return files.join(truth, key, "left")


def attach_label_truth(files: DataFrame, metadata: DataFrame, dataset: str, key: str = "filename", order: str = "row") -> DataFrame:
    """Add ``ground_truth`` labels; only the ravdess dataset has them. Empty becomes null."""
    column = _first_column(metadata, LABEL_TRUTH_COLUMNS)
    if dataset != "ravdess" or column is None:
        return files.withColumn("ground_truth", F.lit(None).cast("string"))
    truth = metadata.groupBy(key).agg(
        F.nullif(F.min_by(F.col(column).cast("string"), order), F.lit("")).alias("ground_truth")
    )
    return files.join(truth, key, "left")


def two_key_lookup(files: DataFrame, results: DataFrame, own_key: str, owner_key: str, key: str = "key", payload: str = "payload") -> DataFrame:
    """Payload under the session's own key, otherwise under the dataset owner's key."""
    own = results.select(F.col(key).alias(own_key), F.col(payload).alias("_own"))
    owner = results.select(F.col(key).alias(owner_key), F.col(payload).alias("_owner"))
    return (
        files.join(own, own_key, "left")
        .join(owner, owner_key, "left")
        .withColumn(payload, F.coalesce("_own", "_owner"))
        .drop("_own", "_owner")
    )


def apply_predictions(rows: DataFrame, results: DataFrame, path: str, name: str = "file", payload: str = "payload") -> DataFrame:
    """Give table rows the cached result of their file name; status is done or idle."""
    held = results.select(F.col(name).alias("_file"), F.col(payload))
    return (
        rows.withColumn("_file", file_name(F.col(path)))
        .join(held, "_file", "left")
        .withColumn("status", F.when(F.col(payload).isNotNull(), "done").otherwise("idle"))
        .drop("_file")
    )


def match_selection(rows: DataFrame, selection: DataFrame, id_col: str, path: str, wanted: str = "wanted") -> DataFrame:
    """Rows whose id or path equals a wanted value, or whose path ends with a slash and the value.

    Each row offers its id and every tail of its path after a slash, so the "ends with" test is an equality and no pair
    that does not match is ever built.
    """
    pieces = F.split(F.col(path), r"[/\\]")
    length = F.length(path)
    # start of the tail that begins at piece i: total length of the pieces before it plus one slash each
    tails = F.transform(
        F.sequence(F.lit(1), F.size(pieces)),
        lambda i: F.substring(
            F.col(path),
            F.lit(1) + F.aggregate(F.slice(pieces, F.lit(1), i - 1), F.lit(0), lambda s, p: s + F.length(p) + 1),
            length,
        ),
    )
    offered = F.array_distinct(F.concat(F.array(F.col(id_col).cast("string")), tails))
    keyed = rows.withColumn(wanted, F.explode(offered))
    return keyed.join(selection.select(wanted).distinct(), wanted)
