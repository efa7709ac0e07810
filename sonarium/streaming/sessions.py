"""Stateful session streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sonarium.functions.fixed import SESSION_TTL
from sonarium.operators.blocks import BLOCK_BITS, attach_small, number_rows, spread_bits

QUEUE_OUT = StructType(
    [
        StructField("session_id", LongType()),
        StructField("op", StringType()),
        StructField("seq", LongType()),
        StructField("key", StringType()),
        StructField("value", StringType()),
    ]
)
LIFE = StructType([StructField("first", LongType()), StructField("touched", LongType()), StructField("last", LongType())])
STEP = StructType([StructField("step", LongType())])
TOUCH = StructType([StructField("low", LongType()), StructField("high", LongType()), StructField("seq", LongType())])
KEY = StructType([StructField("key", StringType())])
PATCH = StructType([StructField("seq", LongType()), StructField("value", StringType())])


_LEAST = -(1 << 63)

Touch = tuple[int, int, int]


def _by_step(at: np.ndarray, seq: np.ndarray, step_us: int) -> Iterator[tuple[int, int, int, int]]:
    """``step, low, high, seq``: the first and last touch and the least command of each step of time."""
    order = np.argsort(at, kind="stable")
    at, seq = at[order], seq[order]
    step = at // step_us
    starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
    ends = np.r_[starts[1:], len(step)] - 1
    yield from zip(step[starts].tolist(), at[starts].tolist(), at[ends].tolist(), map(int, np.fmin.reduceat(seq, starts)))


def _merged(touch: Sequence[int], other: Touch | None) -> Touch:
    low, high, seq = touch
    return (low, high, seq) if other is None else (min(low, other[0]), max(high, other[1]), min(seq, other[2]))


class QueueState(StatefulProcessor):
    """One session's state: when its present life began, that life's stretch of touches, and the last value of each progress key.

    Rows of a batch are taken piece by piece, in whatever order the shuffle brings them, and nothing is kept of a piece but its touches:
    one entry per step of at most an hour, inside which no break can lie. When the batch is through, the breaks between steps say where the
    life began. Touches after the last break have no break between them, and later ones can only fill gaps, so they are stored as one entry:
    the first step with its commands, and the newest touch. A session calls its state a fixed number of times a batch, and once or twice per
    progress key that moved. Items pass on to the sink at once, so the state does not grow with the queue.
    """

    def __init__(self, ttl_s: int = SESSION_TTL):
        self.ttl_us, self.step_us = ttl_s * 1_000_000, min(3600, ttl_s) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", LIFE)
        self.touches = handle.getMapState("touches", STEP, TOUCH)
        self.progress = handle.getMapState("progress", KEY, PATCH)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.life.get()
        first, touched, final = held if held else (None, _LEAST, _LEAST)
        begun = first
        steps: dict[int, Touch] = {}
        patches: dict[str, tuple[int, str]] = {}
        for piece in rows:
            at = piece["at"].astype("datetime64[us, UTC]" if piece["at"].dt.tz else "datetime64[us]").astype("int64")
            op, seq = piece["op"].to_numpy(), piece["seq"].to_numpy()
            cleared = seq[op == "clear"]
            if len(cleared):
                first = max(int(np.fmax.reduce(cleared)) + 1, _LEAST if first is None else first)
            for step, *touch in _by_step(at.to_numpy(), seq, self.step_us):
                steps[step] = _merged(touch, steps.get(step))
            touched, final = max(int(at.max()), touched), max(int(np.fmax.reduce(seq)), final)
            last: dict[str, tuple[int, str]] = {}
            moving = op == "progress"
            for name, number, value in zip(piece["key"].to_numpy()[moving], seq[moving].tolist(), piece["value"].to_numpy()[moving]):
                if name not in last or last[name][0] <= number:
                    last[name] = (int(number), value)
            for name, patch in last.items():
                if name not in patches or patches[name][0] < patch[0]:
                    patches[name] = patch
            adding = op == "add"
            if adding.any():
                yield piece.loc[adding, ["op", "seq", "key", "value"]].assign(session_id=key[0])[QUEUE_OUT.names]
        first = self._life_from_breaks(first, steps, held is not None)
        self.life.update((first, touched, final))
        changes = []
        if first != begun:
            # progress of an earlier life is forgotten
            for (name,), (seq, _) in list(self.progress.iterator()) if held else ():
                if first is not None and seq < first:
                    self.progress.removeKey((name,))
            changes.append(("life", first, None, None))
        for name, (seq, value) in patches.items():
            known = self.progress.getValue((name,)) if held and self.progress.containsKey((name,)) else None
            if (first is None or seq >= first) and (known is None or known[0] < seq):
                self.progress.updateValue((name,), (seq, value))
                changes.append(("progress", seq, name, value))
        if changes:
            yield self._rows(key, changes)
        for timer in list(self.handle.listTimers()) if held else ():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((touched + self.ttl_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The lifetime has passed without a touch: the session's state goes, and a mark says that what comes next is another life."""
        ended = self._rows(key, [("expired", self.life.get()[2] + 1, None, None)])
        self.life.clear()
        self.touches.clear()
        self.progress.clear()
        yield ended

    def close(self) -> None:
        pass

    def _life_from_breaks(self, first: int | None, steps: dict[int, Touch], held: bool) -> int | None:
        """The life's first command after the last break; what touched it since is stored as one entry."""
        known = {step: touch for (step,), touch in list(self.touches.iterator())} if held else {}
        for step, touch in known.items():
            steps[step] = _merged(touch, steps.get(step))
        start, newest = None, _LEAST
        for step in sorted(steps):
            low, high, seq = steps[step]
            if start is None:
                start = step
            elif low - newest >= self.ttl_us:
                start = step
                first = max(seq, first if first is not None else seq)
            newest = max(newest, high)
        if start is not None:
            for step in known:
                if step != start:
                    self.touches.removeKey((step,))
            self.touches.updateValue((start,), (steps[start][0], newest, steps[start][2]))
        return first

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[f.name for f in QUEUE_OUT.fields])


def queue_stream(commands: DataFrame, delay: str = "24 hours", ttl_s: int = SESSION_TTL) -> DataFrame:
    """Changes of the sessions' queues ``(session_id, op, seq, key, value)``: ``add`` for each item, ``progress`` for each key that moved, ``life`` where a life began,
    ``expired`` where one ended for good.

    ``commands`` has a time ``at`` that does not fall along ``seq``. :func:`queue_now` and :func:`progress_now` read the present state from the
    table the stream was written to; it is the same however the stream was cut into batches. A session's state is one value, one
    entry for the touches of its present life and one per progress key; it goes once the watermark has passed the last touch by the lifetime.
    Needs the RocksDB state store (:func:`sonarium.session.build_session` sets it).
    """
    return (
        commands.withWatermark("at", delay)
        .groupBy("session_id")
        .transformWithStateInPandas(QueueState(ttl_s), QUEUE_OUT, "Append", "EventTime")
    )


def _present(changes: DataFrame, op: str, expired: bool) -> DataFrame:
    """Rows of each session's present life. A mark of expiry counts if anything followed it, or, with ``expired``, in any case."""
    mark = F.when(F.col("op") == "expired", F.col("seq"))
    ends = changes.groupBy("session_id").agg(
        F.max(F.when(F.col("op") == "life", F.col("seq"))).alias("_life"),
        F.max(F.when(F.col("op") != "expired", F.col("seq"))).alias("_last"),
        F.collect_set(mark).alias("_ends"),  # one a lifetime at most
    )
    over = F.array_max("_ends" if expired else F.filter("_ends", lambda e: e <= F.col("_last")))
    lives = ends.select("session_id", F.greatest("_life", over).alias("_first"))
    rows = attach_small(changes.filter(F.col("op") == op), lives, ["session_id"], "left")
    return rows.filter(F.col("_first").isNull() | (F.col("seq") >= F.col("_first"))).drop("_first")


def queue_now(changes: DataFrame, expired: bool = False, bits: int = BLOCK_BITS) -> DataFrame:
    """Waiting items ``(session_id, position, item)`` of the table :func:`queue_stream` was written to, numbered block by block.

    With ``expired`` the queues of sessions whose lifetime the watermark has passed are empty; otherwise they are as they were left.
    """
    items = _present(changes, "add", expired).select("session_id", "seq", F.col("value").alias("item"))
    return number_rows(items, ["session_id"], "seq", "position", spread_bits(changes, "seq", bits)).select("session_id", "position", "item")


def progress_now(changes: DataFrame, expired: bool = False) -> DataFrame:
    """Merged progress ``(session_id, key, value)``: the last value of each key in the session's present life."""
    return _present(changes, "progress", expired).groupBy("session_id", "key").agg(F.max_by("value", "seq").alias("value"))


def session_stream(touches: DataFrame, at: str, delay: str = "24 hours", gap: str = "24 hours", keys: tuple[Column | str, ...] = ("session_id",)) -> DataFrame:
    """Closed session lifetimes of a stream; late touches within ``delay`` of the newest one still count."""
    window = F.session_window(at, gap)
    return (
        touches.withWatermark(at, delay)
        .groupBy(*keys, window.alias("_w"))
        .agg(F.count(F.lit(1)).alias("touches"))
        .select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "touches")
    )
