"""Scores of time segments: frames ``(clip, i, x)``, segments ``(clip, seg, start, end, word)``, ``(clip, duration)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions.text import words
from sonarium.operators.blocks import attach_by_block, number_rows, with_group_stats
from sonarium.operators.catalog import top_per_group
from sonarium.session import settle


def clip_frames(frames: DataFrame, durations: DataFrame) -> DataFrame:
    """(clip, _frames, _duration) of clips with frames and a positive duration."""
    counts = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("_frames"))
    return counts.join(durations.filter(F.col("duration") > 0).withColumnRenamed("duration", "_duration"), "clip")


#: The frame tree: a node of level k covers ``4**k`` positions, up to blocks of 4096.
LEVELS = 7


def frame_tree(frames: DataFrame) -> DataFrame:
    """``clip, level, node, s, n``: sum and number of the values that are not null below each node of the frame tree.

    Level 0 are the frames themselves; a third as many rows again are the other levels. Nodes combine before the shuffle, and none has
    more than 4096 frames, so no clip is a hot spot.
    """
    known = frames.filter(F.col("x").isNotNull()).select("clip", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    leveled = known.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    node = F.call_function("shiftright", F.col("i"), 2 * F.col("level"))
    return leveled.groupBy("clip", "level", node.alias("node")).agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))


def covering_nodes(first: Column, end: Column) -> Column:
    """Array of ``(level, low, high)``: runs of nodes that together cover the positions from ``first`` up to ``end``, each once.

    A level gives what lies inside the stretch and outside the nodes of the next level: three nodes at most at either end, so a stretch is
    covered by a number of nodes that grows with the logarithm of its length (whole blocks by themselves).
    """

    def inside(level: int) -> tuple[Column, Column]:
        bits = 2 * level
        return F.shiftright(first + (1 << bits) - 1, bits), F.shiftright(end, bits)

    runs = []
    for level in range(LEVELS):
        low, high = inside(level)
        if level == LEVELS - 1:
            runs.append((level, low, high))
            continue
        above = inside(level + 1)
        none = above[0] >= above[1]
        runs.append((level, low, F.when(none, high).otherwise(above[0] * 4)))
        runs.append((level, F.when(none, high).otherwise(above[1] * 4), high))
    return F.array(*[F.struct(F.lit(k).alias("level"), a.alias("low"), b.alias("high")) for k, a, b in runs])


def _mean_over_frames(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean frame score of each segment; segments carry ``_frames`` and ``_duration``.

    A segment becomes the few nodes of the frame tree that cover it and meets them by equality: no range join, no row per frame, and
    nothing is subtracted, so a value that is not finite, or very large, touches only the segments that cover it.
    """
    fps = F.col("_frames") / F.col("_duration")
    first = F.greatest(F.lit(0), F.least(F.col("_frames") - 1, F.floor(F.col("start") * fps)))
    end = F.greatest(F.col("_a") + 1, F.least(F.col("_frames"), F.floor(F.col("end") * fps)))
    kept = ["clip", "seg", "start", "end", "word"]
    edges = segments.withColumn("_a", first).withColumn("_b", end)
    runs = edges.select(*kept, F.inline(covering_nodes(F.col("_a"), F.col("_b")))).filter(F.col("low") < F.col("high"))
    nodes = runs.select(*kept, "level", F.explode(F.sequence("low", F.col("high") - 1)).alias("node"))
    sums = nodes.join(frame_tree(frames), ["clip", "level", "node"]).groupBy(*kept).agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    return sums.select(*kept, (F.col("_s") / F.col("_n")).alias("saliency"))


def score_word_segments(frames: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Mean score per word; words with end ≤ start, start < 0 or end > duration are left out."""
    sizes = clip_frames(frames, durations).join(
        segments.groupBy("clip").agg(F.min("seg").alias("_s0"), F.max("seg").alias("_s1")), "clip"
    )
    sized = attach_by_block(segments, sizes, ["clip"], "seg", "_s0", "_s1")
    valid = (F.col("end") > F.col("start")) & (F.col("start") >= 0) & (F.col("end") <= F.col("_duration"))
    return _mean_over_frames(sized.filter(valid), frames)


def score_uniform_segments(frames: DataFrame, durations: DataFrame, pieces: int | None = None) -> DataFrame:
    """Equal time pieces: max(8, min(32, int(2·duration))) named ``segment_1`` …, or a given number without names."""
    sizes = clip_frames(frames, durations)
    n = F.lit(pieces).cast("long") if pieces else F.greatest(F.lit(8), F.least(F.lit(32), F.floor(F.col("_duration") * 2)))
    k = F.col("seg")
    split = sizes.withColumn("_m", n).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    named = split.withColumns(
        {
            "start": k / F.col("_m") * F.col("_duration"),
            "end": (k + 1) / F.col("_m") * F.col("_duration"),
            "word": F.lit(None).cast("string") if pieces else F.concat(F.lit("segment_"), (k + 1).cast("string")),
        }
    )
    return _mean_over_frames(named, frames)


def score_segments(frames: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Word segments; clips of which no word survives get uniform ones."""
    by_word = score_word_segments(frames, segments, durations)
    without = durations.join(by_word.select("clip").distinct(), "clip", "left_anti")
    uniform = score_uniform_segments(frames.join(without.select("clip"), "clip", "left_semi"), without)
    return by_word.unionByName(uniform)


def segment_intensity(scored: DataFrame) -> DataFrame:
    """|s| / max|s| per clip, at least 0.1; where all are at most 1e-9 the rank by |s| gives 1 - 0.9·rank/n.

    The rank of such a clip is the number of larger values, from counts per distinct value, plus the number among equals.
    """
    size = F.abs("saliency")
    ranged = settle(with_group_stats(scored, ["clip"], "seg", _max=("max", size), _n=("count", F.lit(1))))
    loud = ranged.filter(F.col("_max") > 1e-9).withColumn("intensity", size / F.col("_max"))
    faint = ranged.filter(F.col("_max") <= 1e-9).withColumn("_size", size)
    larger = Window.partitionBy("clip").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        faint.groupBy("clip", "_size")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("seg").alias("_s0"), F.max("seg").alias("_s1"))
        .withColumn("_ahead", F.coalesce(F.sum("_c").over(larger), F.lit(0)))
        .drop("_c")
    )
    numbered = number_rows(faint, ["clip", "_size"], "seg", "_k")
    ranked = attach_by_block(numbered, ahead, ["clip", "_size"], "seg", "_s0", "_s1").withColumn(
        "intensity", 1.0 - (F.col("_ahead") + F.col("_k")) / F.col("_n") * 0.9
    )
    kept = [*scored.columns, "intensity"]
    return (
        loud.select(*kept)
        .unionByName(ranked.select(*kept))
        .withColumn("intensity", F.greatest(F.lit(0.1), F.col("intensity")))
    )


def top_segments(segments: DataFrame, k: int = 5) -> DataFrame:
    """The k most intense segments per clip, ties by segment."""
    return top_per_group(segments, ["clip"], [F.desc("intensity"), F.asc("seg")], k)


def interpolate_word_times(phrases: DataFrame, text: str = "text") -> DataFrame:
    """A timed phrase of several words becomes equal spans, one per word.

    Phrases with one word, or that end no later than they start, stay as they are; phrases lacking a time are dropped.
    """
    timed = phrases.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    trimmed = F.trim(F.col(text))
    pieces = words(trimmed)
    single = (F.size(pieces) <= 1) | (F.col("end") <= F.col("start"))
    spread = timed.withColumn("_w", F.when(single, F.array(trimmed)).otherwise(pieces))
    span = (F.col("end") - F.col("start")) / F.size("_w")
    rest = [c for c in phrases.columns if c not in (text, "start", "end")]
    out = spread.select(*rest, "start", "end", span.alias("_span"), F.posexplode("_w").alias("piece", "word"), F.size("_w").alias("_m"))
    one = F.col("_m") == 1
    return out.select(
        *rest,
        "piece",
        "word",
        F.when(one, F.col("start")).otherwise(F.col("start") + F.col("piece") * F.col("_span")).alias("start"),
        F.when(one, F.col("end")).otherwise(F.col("start") + (F.col("piece") + 1) * F.col("_span")).alias("end"),
    )


def segment_share(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Width of each segment in percent of the clip, at least 0.1."""
    totals = durations.join(
        segments.groupBy("clip").agg(F.min("seg").alias("_s0"), F.max("seg").alias("_s1")), "clip"
    ).withColumnRenamed("duration", "_total")
    sized = attach_by_block(segments, totals, ["clip"], "seg", "_s0", "_s1")
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    share = F.greatest(F.lit(0.1), length / F.greatest(F.lit(0.001), F.col("_total")) * 100)
    return sized.withColumn("width_percent", share).drop("_total")
