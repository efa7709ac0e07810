"""Attention tables. Cells: long ``(clip, layer, head, i, j, w)``; one chosen head: ``(clip, i, j, w)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonarium.operators.blocks import attach_by_block, with_group_stats
from sonarium.operators.catalog import top_per_group

# blocks of 64 matrix rows
ROW_BITS = 6


def explode_attention(df: DataFrame, clip: str = "clip", attention: str = "attention") -> DataFrame:
    """Nested [layer][head][i][j] to one row per cell; row-local."""
    layers = df.select(F.col(clip).alias("clip"), F.posexplode(attention).alias("layer", "_l"))
    heads = layers.select("clip", "layer", F.posexplode("_l").alias("head", "_h"))
    rows = heads.select("clip", "layer", "head", F.posexplode("_h").alias("i", "_r"))
    return rows.select("clip", "layer", "head", "i", F.posexplode("_r").alias("j", "w"))


def truncate_attention(cells: DataFrame, heads: int, positions: int) -> DataFrame:
    """The cells of the first heads and positions, for a caller that wants a corner of the matrix only."""
    return cells.filter((F.col("head") < heads) & (F.col("i") < positions) & (F.col("j") < positions))


def pick_head(cells: DataFrame, layer: int = 6, head: int = 0) -> DataFrame:
    """Cells of one layer and head per clip; a layer or head the clip does not have becomes 0.

    Only four (layer, head) combinations can be the answer, so all others are cut at the scan.
    """
    candidates = cells.filter(F.col("layer").isin(layer, 0) & F.col("head").isin(head, 0))
    chosen_layer = F.when(F.max((F.col("layer") == layer).cast("int")) == 1, layer).otherwise(0)
    per_layer = candidates.groupBy("clip", F.col("layer").alias("_layer")).agg(
        F.max((F.col("head") == head).cast("int")).alias("_has"), F.min("i").alias("_i0"), F.max("i").alias("_i1")
    )
    wanted = per_layer.join(
        candidates.groupBy("clip").agg(chosen_layer.alias("_pick")), "clip"
    ).filter(F.col("_layer") == F.col("_pick")).select(
        "clip", "_layer", F.when(F.col("_has") == 1, head).otherwise(0).alias("_head"), "_i0", "_i1"
    )
    placed = attach_by_block(candidates, wanted, ["clip"], "i", "_i0", "_i1", ROW_BITS)
    return placed.filter((F.col("layer") == F.col("_layer")) & (F.col("head") == F.col("_head"))).select(
        "clip", "i", "j", "w"
    )


def pick_head_nested(df: DataFrame, attention: str, layer: int = 6, head: int = 0) -> DataFrame:
    """The same on nested arrays, inside the row."""
    a = F.col(attention)
    of_layer = F.get(a, F.when(F.size(a) > layer, layer).otherwise(0))
    return df.withColumn(attention, F.get(of_layer, F.when(F.size(of_layer) > head, head).otherwise(0)))


def attention_pairs(words: DataFrame, matrix: DataFrame) -> DataFrame:
    """Weight between every ordered pair of words of a clip, from words ``(clip, idx, word, start, end)`` and one head.

    Word k reads row/column min(k, size-1). The pairs come from the matrix: each cell meets the words of its row and of its
    column by equality, so the work is that of the result and no word list is ever joined with itself.
    """
    sizes = matrix.groupBy("clip").agg((F.max("i") + 1).alias("_rows"), (F.max("j") + 1).alias("_cols"))
    extent = words.groupBy("clip").agg(F.min("idx").alias("_k0"), F.max("idx").alias("_k1"))
    sized = attach_by_block(words, sizes.join(extent, "clip"), ["clip"], "idx", "_k0", "_k1")
    sides = {}
    for side, axis, limit in (("from", "i", "_rows"), ("to", "j", "_cols")):
        sides[side] = sized.select(
            "clip",
            F.least(F.col("idx"), F.col(limit) - 1).alias(axis),
            F.col("idx").alias(f"{side}_index"),
            F.col("word").alias(f"{side}_word"),
            F.col("start").alias(f"{side}_start"),
            F.col("end").alias(f"{side}_end"),
        )
    cells = matrix.select("clip", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "w")
    return (
        cells.join(sides["from"], ["clip", "i"])
        .join(sides["to"], ["clip", "j"])
        .withColumnRenamed("w", "attention_weight")
        .drop("i", "j")
    )


def frame_measures(matrix: DataFrame) -> DataFrame:
    """Per (clip, frame): strongest outgoing weight, sum of incoming, self attention, normalised entropy of the row."""
    row = Window.partitionBy("clip", "i")
    p = F.col("w") / F.col("_sum")
    rows = (
        matrix.withColumn("_sum", F.sum("w").over(row))
        .groupBy("clip", F.col("i").cast("long").alias("frame_index"))
        .agg(
            F.max("w").alias("max_outgoing"),
            F.sum(F.when(F.col("_sum") > 0, -p * F.log(p + 1e-10))).alias("_entropy"),
            F.count(F.lit(1)).alias("_len"),
            F.max("_sum").alias("_total"),
            F.coalesce(F.max(F.when(F.col("i") == F.col("j"), F.col("w"))), F.lit(0.0)).alias("self_attention"),
        )
    )
    columns = matrix.groupBy("clip", F.col("j").cast("long").alias("frame_index")).agg(F.sum("w").alias("_incoming"))
    usable = (F.col("_total") > 0) & (F.col("_len") > 1)
    return rows.join(columns, ["clip", "frame_index"], "left").select(
        "clip",
        "frame_index",
        "max_outgoing",
        F.coalesce("_incoming", F.lit(0.0)).alias("incoming"),
        "self_attention",
        F.when(usable, F.col("_entropy") / F.log(F.col("_len"))).otherwise(0.0).alias("attention_entropy"),
    )


def attention_timeline(words: DataFrame, matrix: DataFrame, step: float = 0.1) -> DataFrame:
    """Attention along time: one row per step until the end of the last word, looked up by equality on its frame.

    The steps are counted as whole numbers, so the grid is the same wherever a clip's rows are. A clip without a matrix has
    attention 0 at frame 0.
    """
    ends = words.groupBy("clip").agg(F.max_by("end", "idx").alias("_duration"))
    sizes = matrix.groupBy("clip").agg((F.max("i") + 1).cast("long").alias("_n"))
    grid = ends.join(sizes, "clip", "left").filter(F.col("_duration") > 0).withColumn(
        "point", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_duration") / step) - 1))
    )
    t = F.col("point") * step
    placed = grid.select(
        "clip",
        "point",
        t.alias("time"),
        F.when(F.col("_n").isNull(), 0)
        .otherwise(F.least(F.floor(t / F.col("_duration") * F.col("_n")), F.col("_n") - 1))
        .alias("frame_index"),
        "_n",
    )
    return (
        placed.join(frame_measures(matrix), ["clip", "frame_index"], "left")
        .withColumn("avg_incoming", F.col("incoming") / F.col("_n"))
        .withColumn(
            "attention", F.coalesce(F.col("max_outgoing") * (0.7 + 0.3 * F.col("attention_entropy")), F.lit(0.0))
        )
        .drop("incoming", "_n")
    )


def timeline_stats(timeline: DataFrame, durations: DataFrame) -> DataFrame:
    """Per clip: min, max, range, number of points and milliseconds per point."""
    stats = timeline.groupBy("clip").agg(
        F.min("attention").alias("min"), F.max("attention").alias("max"), F.count(F.lit(1)).alias("points")
    )
    return stats.join(durations, "clip").select(
        "clip",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        "points",
        (F.col("duration") / F.col("points") * 1000).alias("resolution_ms"),
    )


def timeline_peaks(timeline: DataFrame) -> DataFrame:
    """Marks points above mean + population standard deviation of their clip."""
    stats = timeline.groupBy("clip").agg(
        (F.avg("attention") + F.stddev_pop("attention")).alias("_limit"), F.min("point").alias("_p0"), F.max("point").alias("_p1")
    )
    marked = attach_by_block(timeline, stats, ["clip"], "point", "_p0", "_p1")
    return marked.withColumn("is_peak", F.col("attention") > F.col("_limit")).drop("_limit")


def attention_matrix(pairs: DataFrame) -> DataFrame:
    """Dense matrix from pairs in long form: every (from, to) up to the clip's largest index, 0 where no pair is.

    Each present row is completed by the positions of the clip, not by pairing rows with rows of other clips.
    """
    biggest = pairs.groupBy("clip").agg(F.max(F.greatest("from_index", "to_index")).alias("_m"))
    grid = biggest.withColumn("from_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m")))).withColumn(
        "to_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m")))
    )
    known = pairs.groupBy("clip", "from_index", "to_index").agg(F.max("attention_weight").alias("w"))
    return grid.drop("_m").join(known, ["clip", "from_index", "to_index"], "left").withColumn(
        "w", F.coalesce("w", F.lit(0.0))
    )


def attention_grid(pairs: DataFrame, columns: Sequence[int]) -> DataFrame:
    """Wide view of the matrix for the given column positions, as the 50-word display does."""
    return (
        pairs.groupBy("clip", "from_index")
        .pivot("to_index", list(columns))
        .agg(F.max("attention_weight"))
        .na.fill(0.0)
        .select("clip", "from_index", *[F.col(f"`{c}`").alias(f"to_{c}") for c in columns])
    )


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Strongest pairs of different words per clip."""
    return top_per_group(
        pairs.filter(F.col("from_index") != F.col("to_index")),
        ["clip"],
        [F.desc("attention_weight"), F.asc("from_index"), F.asc("to_index")],
        k,
    )


def pair_intensity(pairs: DataFrame) -> DataFrame:
    """Display intensity: 0.8 for a word with itself, otherwise the place in [min(0, …), max(1, …)], at least 0.1."""
    other = (F.col("from_index") != F.col("to_index")) & (F.col("attention_weight") > 0)
    w = F.when(other, F.col("attention_weight"))
    ranged = with_group_stats(pairs, ["clip"], "from_index", ROW_BITS, _lo=("min", w), _hi=("max", w))
    low = F.least(F.coalesce("_lo", F.lit(0.0)), F.lit(0.0))
    high = F.greatest(F.coalesce("_hi", F.lit(1.0)), F.lit(1.0))
    return ranged.withColumn(
        "intensity",
        F.when(F.col("from_index") == F.col("to_index"), 0.8).otherwise(
            F.greatest(F.lit(0.1), (F.col("attention_weight") - low) / (high - low))
        ),
    ).drop("_lo", "_hi")
