"""Operators on series in long form ``(clip, i, x)`` with dense positions ``i`` from 0.

All ordered work runs per (clip, block of positions), see :mod:`sonarium.operators.blocks`; a clip may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions.signal import hashed_noise
from sonarium.operators.blocks import (
    BLOCK_BITS,
    attach_by_block,
    match_keys,
    number_rows,
    order_stats,
    with_group_stats,
    with_previous,
)
from sonarium.session import settle

CLIP = ("clip",)


def series_from_arrays(df: DataFrame, clip: str, values: str) -> DataFrame:
    """Long form of one array per clip."""
    return df.select(F.col(clip).alias("clip"), F.posexplode(values).alias("i", "x")).withColumns(
        {"i": F.col("i").cast("long"), "x": F.col("x").cast("double")}
    )


def rms_downsample(series: DataFrame, n: int = 300, bits: int = BLOCK_BITS) -> DataFrame:
    """RMS of n equal blocks; the tail behind the last whole block is dropped, a clip shorter than n gives no rows."""
    size = F.floor(F.col("_n") / n)
    sized = with_group_stats(series, CLIP, "i", bits, _n=("count", F.lit(1))).filter(size > 0)
    return (
        sized.withColumn("point", F.floor(F.col("i") / size))
        .filter(F.col("point") < n)
        .groupBy("clip", "point")
        .agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    )


def is_bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def sanitize(series: DataFrame) -> DataFrame:
    """Non-finite samples become 0."""
    return series.withColumn("x", F.when(is_bad(F.col("x")), 0.0).otherwise(F.col("x")))


def bad_samples(series: DataFrame) -> DataFrame:
    """Non-finite and all samples per clip."""
    return series.groupBy("clip").agg(F.count_if(is_bad(F.col("x"))).alias("bad"), F.count(F.lit(1)).alias("samples"))


def peak_normalize(series: DataFrame, threshold: float = 1.0, bits: int = BLOCK_BITS) -> DataFrame:
    """Divide by the peak where it exceeds the threshold (1 after perturbing, 100 before scoring)."""
    peaked = with_group_stats(series, CLIP, "i", bits, _peak=("max", F.abs("x")))
    return peaked.withColumn(
        "x", F.when(F.col("_peak") > threshold, F.col("x") / F.col("_peak")).otherwise(F.col("x"))
    ).drop("_peak")


def silent_runs(series: DataFrame, rate: int, seconds: float = 1.0, floor: float = 1e-8, bits: int = BLOCK_BITS) -> DataFrame:
    """Maximal runs of |x| < floor that last at least ``seconds``: position minus number among the silent ones is constant."""
    silent = series.filter(F.abs("x") < floor).select("clip", "i")
    runs = (
        number_rows(silent, CLIP, "i", "_k", bits)
        .groupBy("clip", (F.col("i") - F.col("_k")).alias("_run"))
        .agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count(F.lit(1)).alias("samples"))
    )
    return runs.filter(F.col("samples") >= seconds * rate).drop("_run")


def dither_silence(series: DataFrame, rate: int, level: float = 1e-4, seed: int = 0, bits: int = BLOCK_BITS) -> DataFrame:
    """Replace the samples of each silent run of a second or more by faint noise; all others stay.

    A run is listed once for each block of positions it touches, and a block's runs meet its samples, so neither a long run nor
    a long clip meets in one task.
    """
    runs = silent_runs(series, rate, bits=bits).select("clip", "start", "end")
    cut = runs.withColumn("_blk", F.explode(F.sequence(F.shiftright("start", bits), F.shiftright("end", bits))))
    held = cut.groupBy("clip", "_blk").agg(F.collect_list(F.struct("start", "end")).alias("_runs"))
    placed = series.withColumn("_blk", F.shiftright("i", bits)).join(held, ["clip", "_blk"], "left")
    quiet = F.coalesce(F.exists("_runs", lambda r: F.col("i").between(r.start, r.end)), F.lit(False))
    noise = level * hashed_noise(seed, F.col("clip"), F.col("i"))
    return placed.withColumn("x", F.when(quiet, noise).otherwise(F.col("x"))).select(*series.columns)


def crop(series: DataFrame, rate: float, max_seconds: float) -> DataFrame:
    return series.filter(F.col("i") < F.lit(int(max_seconds * rate)))


def crop_chunks(chunks: DataFrame, max_seconds: float, start: str = "start") -> DataFrame:
    """Word chunks that start before the limit."""
    return chunks.filter(F.col(start) < max_seconds)


def window_sums(series: DataFrame, back: Column, ahead: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """Sum of x over positions i-back … i+ahead inside the clip; both widths may depend on the clip's length ``_n``.

    The clip is cut into stretches as long as the window. A window then is the end of one stretch and the beginning of the next,
    so it is the sum of two running sums, one towards each side, and nothing is ever subtracted: a sample that is not finite, or
    very large, touches only the windows that hold it. The running sums are carried over blocks inside a stretch, so the cost
    does not grow with the width and no stretch is one task. Each position sends its two sums to the positions whose windows
    end there; one grouping on (clip, position), which spreads any clip evenly, brings them together.
    """
    sized = with_group_stats(series.select("clip", "i", "x"), CLIP, "i", bits, _n=("count", F.lit(1)))
    sized = sized.withColumns({"_back": back, "_ahead": ahead})
    wide = F.col("_back") + F.col("_ahead") + 1
    cut = sized.withColumns({"_w": F.floor(F.col("i") / wide), "_blk": F.shiftright("i", bits)})
    parts = cut.groupBy("clip", "_w", "_blk").agg(
        F.sum("x").alias("_s"), F.max(F.floor((F.col("_n") - 1) / wide)).alias("_last")
    )
    # sums towards the end run over the falling order: a frame that ends at unboundedFollowing is added up anew for every row
    stretch, falling = Window.partitionBy("clip", "_w").orderBy("_blk"), Window.partitionBy("clip", "_w").orderBy(F.desc("_blk"))
    side = parts.select(
        "clip",
        "_w",
        "_blk",
        F.coalesce(F.sum("_s").over(stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
        F.coalesce(F.sum("_s").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_after"),
        F.sum(F.when(F.col("_w") == F.col("_last"), F.col("_s"))).over(Window.partitionBy("clip")).alias("_tail"),
    )
    placed = match_keys(cut, side, ["clip", "_w", "_blk"], keep="_g")
    up, down = (Window.partitionBy("_g").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in ("i", F.desc("i")))
    summed = placed.withColumns({"_up": F.col("_before") + F.sum("x").over(up), "_down": F.col("_after") + F.sum("x").over(down)})
    nothing = F.lit(None).cast("double")

    def send(target: Column, x: Column, up: Column, down: Column) -> Column:
        kept = [F.col(c) for c in ("_n", "_tail", "_back", "_ahead")]
        return F.struct(target.alias("t"), x.alias("x"), up.alias("up"), down.alias("down"), *kept)

    i = F.col("i")
    sent = summed.select(
        "clip",
        F.inline(
            F.array(
                send(i, F.col("x"), nothing, nothing),
                send(i - F.col("_ahead"), nothing, F.col("_up"), nothing),
                send(i + F.col("_back"), nothing, nothing, F.col("_down")),
            )
        ),
    ).filter((F.col("t") >= 0) & (F.col("t") < F.col("_n")))
    met = sent.groupBy("clip", F.col("t").alias("i")).agg(
        *[F.max(c).alias(c) for c in ("x", "up", "down", "_n", "_tail", "_back", "_ahead")]
    )
    low, high = i - F.col("_back"), F.least(i + F.col("_ahead"), F.col("_n") - 1)
    # the window's end is in the stretch of its beginning, or in the next one; behind the clip's end it is the last stretch
    end = F.when(i + F.col("_ahead") < F.col("_n"), F.col("up")).otherwise(F.col("_tail"))
    together = (
        F.when(low < 0, end)
        .when(F.floor(low / wide) == F.floor(high / wide), F.col("down"))
        .otherwise(F.col("down") + end)
    )
    return met.withColumn("window_sum", together).drop("up", "down", "_tail")


def smooth_centered(series: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Zero-padded box filter of odd width max(3, N div 64); edges divide by the full width too."""
    wide = F.greatest(F.lit(3), F.floor(F.col("_n") / 64))
    half = F.floor(wide / 2)  # an even width grows by one, so half of it reaches each side
    out = window_sums(series, half, half, bits)
    return out.select("clip", "i", (F.col("window_sum") / (2 * F.col("_back") + 1)).alias("x"))


def smooth_trailing(series: DataFrame, strength: float = 0.5, bits: int = BLOCK_BITS) -> DataFrame:
    """Mean of the last min(w, i+1) samples, w = max(1, floor(N/100·(0.1+0.9·strength)))."""
    width = F.greatest(F.lit(1), F.floor(F.col("_n") / 100 * (0.1 + 0.9 * strength)))
    out = window_sums(series, width - 1, F.lit(0).cast("long"), bits)
    return out.select(
        "clip", "i", (F.col("window_sum") / F.least(F.col("_back") + 1, F.col("i") + 1)).alias("x")
    )


def clip_percentile(series: DataFrame, q: float = 0.95, bits: int = BLOCK_BITS) -> DataFrame:
    """Clip to [0, p] at the interpolated percentile where it is positive."""
    cut = order_stats(series, CLIP, "x", {"_p": ("linear", q)}, idx="i")
    capped = attach_by_block(series, cut, CLIP, "i", "_first", "_last", bits)
    x = F.col("x")
    return capped.withColumn(
        "x", F.when(F.col("_p") > 0, F.greatest(F.lit(0.0), F.least(x, F.col("_p")))).otherwise(x)
    ).drop("_p")


def clip_display(series: DataFrame, percent: float = 95.0, bits: int = BLOCK_BITS) -> DataFrame:
    """Cap at the value of rank floor(p/100·(N-1)), p held in 80…99; a cap of 0 counts as 1."""
    q = max(80.0, min(99.0, percent)) / 100
    cut = order_stats(series, CLIP, "x", {"_p": ("floor_n1", q)}, idx="i")
    capped = attach_by_block(series, cut, CLIP, "i", "_first", "_last", bits)
    cap = F.when(F.col("_p") == 0, 1.0).otherwise(F.col("_p"))
    return capped.withColumn("x", F.least("x", cap)).drop("_p")


def minmax(series: DataFrame, mode: str = "series", bits: int = BLOCK_BITS) -> DataFrame:
    """(x-min)/range. ``series``: range + 1e-9; ``display``: range at least 1e-9; ``timeline``: range, or 1 if it is 0."""
    ranged = with_group_stats(series, CLIP, "i", bits, _lo=("min", F.col("x")), _hi=("max", F.col("x")))
    span = F.col("_hi") - F.col("_lo")
    width = {
        "series": span + 1e-9,
        "display": F.greatest(F.lit(1e-9), span),
        "timeline": F.when(span == 0, 1.0).otherwise(span),
    }[mode]
    return ranged.withColumn("x", (F.col("x") - F.col("_lo")) / width).drop("_lo", "_hi")


def absmax_scale(series: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """|x| / max|x|, zeros where the maximum is 0."""
    scaled = with_group_stats(series, CLIP, "i", bits, _m=("max", F.abs("x")))
    return scaled.withColumn(
        "x", F.when(F.col("_m") > 0, F.abs("x") / F.col("_m")).otherwise(F.lit(0.0))
    ).drop("_m")


def collapse_attribution(frames: DataFrame, frame: str = "frame", value: str = "value") -> DataFrame:
    """Series of mean |attribution| per frame from long (clip, frame, dim, value)."""
    return frames.groupBy("clip", F.col(frame).cast("long").alias("i")).agg(F.avg(F.abs(value)).alias("x"))


def energy_series(frames: DataFrame, frame: str = "frame", value: str = "value", bits: int = BLOCK_BITS) -> DataFrame:
    """Mean |h| per frame, scaled by its range."""
    return minmax(collapse_attribution(frames, frame, value), "series", bits)


def flat_fallback(series: DataFrame, energy: DataFrame, clips: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The energy series for clips whose own series is empty or nearly constant, the own series otherwise."""
    spans = series.groupBy("clip").agg((F.max("x") - F.min("x")).alias("_span"))
    lively = spans.filter(F.col("_span") >= tolerance).select("clip")
    kept = series.join(lively, "clip", "left_semi").withColumn("source", F.lit("own"))
    flat = clips.select("clip").join(lively, "clip", "left_anti")
    borrowed = energy.join(flat, "clip", "left_semi").withColumn("source", F.lit("energy"))
    return kept.unionByName(borrowed)


def saliency_series(series: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Display series of attribution scores: smooth, clip at p95, scale to [0, 1]."""
    smooth = settle(smooth_centered(series, bits))  # read five times below
    return minmax(clip_percentile(smooth, 0.95, bits), "series", bits)


def display_series(series: DataFrame, strength: float = 0.5, percent: float = 95.0, bits: int = BLOCK_BITS) -> DataFrame:
    """The viewer's own curve: trailing mean, cap at a percentile rank, scale to [0, 1]."""
    smooth = settle(smooth_trailing(series, strength, bits))  # read five times below
    return minmax(clip_display(smooth, percent, bits), "display", bits)


def tumbling_chunks(series: DataFrame, rate: float, seconds: float = 30.0) -> DataFrame:
    """Number of the chunk a sample falls in, its time offset, and the time inside the clip."""
    size = int(seconds * rate)
    chunk = F.floor(F.col("i") / size)
    return series.withColumns(
        {"chunk": chunk, "offset_s": chunk * size / F.lit(float(rate)), "time_s": F.col("i") / F.lit(float(rate))}
    )


def frame_features(
    series: DataFrame, rate: int, frame: int = 2048, hop: int = 512, centred: bool = True, bits: int = BLOCK_BITS
) -> DataFrame:
    """Duration, sample rate, and RMS energy and zero-crossing rate over overlapping frames, as mean, population std, min and max.

    A sample is sent to the frame/hop frames it lies in and reduced there before the shuffle. A frame counts the sign
    changes between its own samples. Centred frames lie around every hop-th sample: half a frame is padded on each side, with
    silence for the energy and with the edge samples, which change no sign, for the crossings. A clip shorter than one frame makes a
    single frame if frames are not centred.
    """
    pad = frame // 2 if centred else 0
    before = with_previous(series, CLIP, "i", "x", "_before", bits)
    sized = with_group_stats(before, CLIP, "i", bits, _n=("count", F.lit(1)))
    negative, was_negative = F.col("x") < -1e-10, F.col("_before") < -1e-10
    crossing = (F.col("_before").isNotNull() & (negative != was_negative)).cast("int")
    at = F.col("i") + pad
    last_frame = F.greatest(F.lit(0), F.floor((F.col("_n") + 2 * pad - frame) / hop))
    first = F.greatest(F.lit(0), F.ceil((at - frame + 1) / hop))
    last = F.least(F.floor(at / hop), last_frame)
    placed = sized.withColumn("_cross", crossing).withColumn(
        "_f", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    )
    inner = F.when(at > F.col("_f") * hop, F.col("_cross")).otherwise(0)
    frames = placed.groupBy("clip", "_f").agg(
        F.max("_n").alias("_n"),
        F.sqrt(F.sum(F.col("x") * F.col("x")) / frame).alias("rms_energy"),
        (F.sum(inner) / frame).alias("zero_crossing_rate"),
    )
    stats = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return frames.groupBy("clip").agg(
        (F.max("_n") / F.lit(float(rate))).alias("duration"),
        F.lit(rate).alias("sample_rate"),
        *[f(c).alias(f"{c}_{n}") for c in ("rms_energy", "zero_crossing_rate") for n, f in stats.items()],
    )
