"""Session state as a fold of a command log ``(session_id, seq, op, key, value)``; op is add, progress or clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions.fixed import SESSION_TTL
from sonarium.operators.blocks import BLOCK_BITS, number_rows, spread_bits, with_previous


def with_life(commands: DataFrame, ttl_s: int = SESSION_TTL, bits: int = BLOCK_BITS) -> DataFrame:
    """Adds ``_live``: whether a command belongs to its session's present life, after the last clear, and from the last command that followed ``ttl_s`` idle.

    ``commands`` has a time ``at`` that does not fall along ``seq``; numbers may have gaps of any size, also such as all sessions
    share. Rows are shuffled once, into blocks of their session (``_g``); only one row per block meets the session's other blocks, so a busy session is no
    hot spot.
    """
    timed = commands.withColumn("_at", F.unix_micros("at"))
    cut = spread_bits(commands, "seq", bits)
    lagged = with_previous(timed, ["session_id"], "seq", "_at", "_before", cut, keep_block=True)
    idle = F.col("_at") - F.col("_before") >= ttl_s * 1_000_000
    begins = F.when(F.col("op") == "clear", F.col("seq") + 1).when(idle, F.col("seq"))
    blocks = lagged.groupBy("_g").agg(F.max(begins).alias("_begins"))
    life = blocks.select("_g", F.max("_begins").over(Window.partitionBy("_g.session_id")).alias("_first"))
    return lagged.join(life, "_g").withColumn("_live", F.col("_first").isNull() | (F.col("seq") >= F.col("_first"))).drop("_first", "_at", "_before")


def since_clear(commands: DataFrame, ttl_s: int = SESSION_TTL) -> DataFrame:
    """Commands of their session's present life."""
    return with_life(commands, ttl_s).filter("_live").drop("_live", "_g")


def queue_items(commands: DataFrame, ttl_s: int = SESSION_TTL, bits: int = BLOCK_BITS) -> DataFrame:
    """Waiting items in arrival order, one row per item: (session_id, position, item)."""
    live = with_life(commands, ttl_s, bits).filter(F.col("_live") & (F.col("op") == "add"))
    added = live.select("session_id", "seq", F.col("value").alias("item"), "_g")
    numbered = number_rows(added, ["session_id"], "seq", "position", spread_bits(commands, "seq", bits), placed="_g")
    return numbered.select("session_id", "position", "item")


def queue_progress(commands: DataFrame) -> DataFrame:
    """Merged progress: the last value of each key in the session's present life."""
    patches = since_clear(commands).filter(F.col("op") == "progress")
    return patches.groupBy("session_id", "key").agg(F.max_by("value", "seq").alias("value"))


def queue_sizes(commands: DataFrame) -> DataFrame:
    """Per session: number of waiting items and of progress keys; 0 after a clear."""
    live, op = F.col("_live"), F.col("op")
    return with_life(commands).groupBy("session_id").agg(
        F.max("seq").alias("last_seq"),
        F.count_if(live & (op == "add")).alias("items"),
        F.count_distinct(F.when(live & (op == "progress"), F.col("key"))).alias("keys"),
    )


def session_spans(touches: DataFrame, at: Column, ttl_s: int = SESSION_TTL) -> DataFrame:
    """Lifetimes of sessions that end ``ttl_s`` after the last touch.

    Touches are first reduced to one row per session and step (an hour, or the lifetime if that is shorter), which combines on
    the map side: no break can lie inside a step. The breaks are then found on those rows.
    """
    step_s = min(3600, ttl_s)
    micros = F.unix_micros(at.cast("timestamp"))
    hours = (
        touches.select("session_id", micros.alias("_t"))
        .groupBy("session_id", F.floor(F.col("_t") / (step_s * 1_000_000)).alias("_h"))
        .agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy("session_id").orderBy("_h")
    starts = (F.col("_lo") - F.lag("_hi").over(order) >= ttl_s * 1_000_000).cast("int")
    numbered = hours.withColumn("_new", F.coalesce(starts, F.lit(0))).withColumn("span", F.sum("_new").over(order))
    return numbered.groupBy("session_id", "span").agg(
        F.timestamp_micros(F.min("_lo")).alias("start"),
        F.timestamp_micros(F.max("_hi") + ttl_s * 1_000_000).alias("end"),
        F.sum("_c").alias("touches"),
    )
