"""Queues from command logs with gaps in their numbers, folded as a table and as a stream in any number of cuts, against a plain fold."""

import datetime as dt
import random

import pytest

from sonarium.operators import blocks, queue
from sonarium.streaming import arrivals, sessions

SCHEMA = "session_id long, seq long, op string, key string, value string, at timestamp"
START = dt.datetime(2024, 1, 1)
TTL = 24 * 3600


def commands(seed, rows=400, gap=1):
    """Sessions of very different sizes whose numbers come from one counter with gaps; some idle for days."""
    rng = random.Random(seed)
    out, at = [], {}
    seq = -5000
    for _ in range(rows):
        seq += rng.randint(1, gap)
        session = rng.choice([1, 1, 1, 1, 2, 2, 3, rng.randint(4, 30)])
        step = rng.choice([1, 60, 3600, 5 * 3600, 23 * 3600] if rng.random() < 0.95 else [24 * 3600, 80 * 3600])
        at[session] = at.get(session, START) + dt.timedelta(seconds=step)
        op = rng.choices(["add", "progress", "clear"], [8, 4, 0.4])[0]
        out.append((session, seq, op, rng.choice("abc"), f"v{seq}", at[session]))
    return out


def plain(rows):
    items, progress, last = {}, {}, {}
    for session, _, op, key, value, at in sorted(rows, key=lambda r: r[1]):
        if op == "clear" or (session in last and (at - last[session]).total_seconds() >= TTL):
            items[session], progress[session] = [], {}
        last[session] = at
        if op == "add":
            items.setdefault(session, []).append(value)
        elif op == "progress":
            progress.setdefault(session, {})[key] = value
    return (
        {(s, k, v) for s, values in items.items() for k, v in enumerate(values)},
        {(s, k, v) for s, patch in progress.items() for k, v in patch.items()},
    )


@pytest.mark.parametrize("gap, bits", [(1, 1), (3, 4), (100_000, 16), (1 << 40, 4)])
def test_batch_fold_with_gaps(spark, gap, bits):
    rows = commands(gap % 1000 + bits, gap=gap)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {tuple(r) for r in queue.queue_items(df, bits=bits).collect()} == plain(rows)[0]
    assert {tuple(r) for r in queue.queue_progress(df).collect()} == plain(rows)[1]


def test_two_far_commands(spark):
    rows = [(7, 1, "add", "a", "x", START), (7, 100_000, "add", "a", "y", START + dt.timedelta(days=7))]
    assert [tuple(r) for r in queue.queue_items(spark.createDataFrame(rows, SCHEMA)).collect()] == [(7, 0, "y")]
    assert queue.queue_items(spark.createDataFrame([], SCHEMA)).count() == 0


def test_previous_value_across_empty_blocks(spark):
    rng = random.Random(2)
    rows = [(g, i, None if rng.random() < 0.2 else rng.random()) for g in (None, 1, 2) for i in rng.sample(range(-(1 << 40), 1 << 40), 50)]
    df = spark.createDataFrame(rows, "g long, i long, x double")
    for bits in (3, 30, 36, blocks.spread_bits(df, "i", 4)):
        got = {(r.g, r.i): r.before for r in blocks.with_previous(df, ["g"], "i", "x", "before", bits).collect()}
        for g in (None, 1, 2):
            mine = sorted(r[1:] for r in rows if r[0] == g)
            assert [got[g, i] for i, _ in mine] == [None, *[x for _, x in mine[:-1]]]


@pytest.mark.parametrize("cuts, gap", [(1, 1 << 30), (2, 1), (4, 1 << 30)])
def test_stream_in_any_number_of_cuts(spark, tmp_path, cuts, gap):
    rows = sorted(commands(17, gap=gap), key=lambda r: r[5])
    # cut along time, as a stream comes; numbers then rise within a session
    size = -(-len(rows) // cuts)
    drops = str(tmp_path / "drops")
    for k in range(cuts):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(f"{drops}/one")
    stream = arrivals.read_drops(spark, f"{drops}/one", part.schema, files_per_batch=1)
    out = str(tmp_path / "out")
    sessions.queue_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True
    ).start().awaitTermination()
    changes = spark.read.schema(sessions.QUEUE_OUT).parquet(out)
    items, progress = plain(rows)
    assert {tuple(r) for r in sessions.queue_now(changes).collect()} == items
    assert {tuple(r) for r in sessions.queue_now(changes, bits=2).collect()} == items
    assert {tuple(r) for r in sessions.progress_now(changes).collect()} == progress
    assert {tuple(r) for r in sessions.queue_now(changes, expired=True).collect()} <= items


def test_pieces_of_a_batch_in_any_order(spark, tmp_path):
    """One session's rows of one batch come in many Arrow pieces; none is joined to another."""
    rng = random.Random(4)
    rows = [(1, i * 977, rng.choice(["add", "add", "progress"]), rng.choice("ab"), f"v{i}", START + dt.timedelta(minutes=40 * i)) for i in range(600)]
    rows[300] = (*rows[300][:2], "clear", *rows[300][3:])
    shuffled = rng.sample(rows, len(rows))
    spark.createDataFrame(shuffled, SCHEMA).repartition(5).write.parquet(str(tmp_path / "in"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        stream = arrivals.read_drops(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
        out = str(tmp_path / "out")
        sessions.queue_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(
            availableNow=True
        ).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    changes = spark.read.schema(sessions.QUEUE_OUT).parquet(out)
    assert {tuple(r) for r in sessions.queue_now(changes).collect()} == plain(rows)[0]
    assert {tuple(r) for r in sessions.progress_now(changes).collect()} == plain(rows)[1]


class CountedState:
    """A session's state in a dict, with the number of calls it got; every call is a round trip from Python to the JVM."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, [], {}

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {"listTimers": lambda: list(self.timers), "deleteTimer": lambda t: self.timers.remove(t), "registerTimer": lambda t: self.timers.append(t)}[name](*args)

        return call

    def getValueState(self, name, schema):
        return CountedValue(self, name)

    def getMapState(self, name, key, value):
        return CountedValue(self, name)


class CountedValue:
    def __init__(self, state, name):
        self.state, self.name = state, name
        state.held.setdefault(name, {})

    def __getattr__(self, call):
        mine = self.state.held[self.name]

        def counted(*args):
            self.state.calls += 1
            forms = {
                "get": lambda: mine.get(()), "update": lambda v: mine.update({(): v}), "iterator": lambda: iter(list(mine.items())), "containsKey": lambda k: k in mine,
                "getValue": lambda k: mine.get(k), "updateValue": lambda k, v: mine.update({k: v}), "removeKey": lambda k: mine.pop(k), "clear": mine.clear,
            }
            return forms[call](*args)

        return counted


class Watermark:
    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_calls_to_the_state_do_not_grow_with_the_touches(cuts):
    import pandas as pd

    rng = random.Random(cuts)
    rows = [(k, rng.choice(["add", "progress"]), rng.choice("ab"), f"v{k}", START + dt.timedelta(hours=k + (30 if k >= 100 else 0))) for k in range(300)]
    frame = pd.DataFrame(rows, columns=["seq", "op", "key", "value", "at"])
    state = CountedState()
    out, size = [], -(-len(rows) // cuts)
    for k in range(cuts):
        batch = frame.iloc[k * size : (k + 1) * size].sample(frac=1, random_state=k)
        fold = sessions.QueueState()
        fold.init(state)
        before = state.calls
        out += fold.handleInputRows((1,), iter([batch.iloc[:40], batch.iloc[40:]] if len(batch) > 40 else [batch]), Watermark())
        assert state.calls - before <= 20
    lives = [r.seq for piece in out for r in piece.itertuples() if r.op == "life"]
    assert lives == [100]
    assert len(state.held["touches"]) == 1 and len(state.timers) == 1
    assert state.held["progress"] == {(n,): max((r[0], r[3]) for r in rows if r[1] == "progress" and r[2] == n) for n in "ab"}
