"""Result log: snapshots in place of the parts they stand for, what a read scans, and filters that leave parts out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.operators.results import latest_results
from sonarium.sources.results import LOG_TYPE, ResultLog, filter_bits, filter_hits



def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def rows(spark, low, high, at, payload, models=("m", "n")):
    data = [(None if k == 3 else f"k{k}", f"{payload}{k}", at * 60 + k % 7, k, 10 * 86400, m) for k in range(low, high) for m in models]
    df = spark.createDataFrame(data, "key string, payload string, t long, seq long, ttl_s int, model string")
    return df.withColumn("written_at", F.timestamp_seconds(F.lit(1_704_103_200) + F.col("t"))).select(*LOG_TYPE.names)


def state(log):
    return sorted((r.model, r.key or "", r.payload) for r in latest_results(log.log()).collect())


def test_snapshots_stand_for_the_parts_before_them(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"), part_keys=40)
    written = []
    for step, (low, high) in enumerate([(0, 100), (50, 150), (0, 10), (140, 160)]):
        written.append(rows(spark, low, high, step, f"w{step}-"))
        log.append(written[-1])
        if step in (1, 2):
            before, old = state(log), log.log().inputFiles()
            assert log.compact() == step
            assert state(log) == before
            assert not set(log.log().inputFiles()) & set(old)
    everything = written[0]
    for w in written[1:]:
        everything = everything.unionByName(w)
    want = sorted((r.model, r.key or "", r.payload) for r in latest_results(everything).collect())
    assert state(log) == want
    # one later append beside the newest snapshot, and a snapshot of several parts of about 40 keys
    parts = log.parts()
    assert sum(p.startswith("delta-") for p in parts) == 1 and len(parts) > 4
    counts = [log.log([p]).count() for p in parts if p.startswith("snap-")]
    assert max(counts) <= 80
    assert log.vacuum() >= 3 and state(log) == want
    assert set(log.parts()) == set(parts)
    for name in ("parts", "filters"):
        assert log._names(name)
    assert {n.removeprefix("part=") for n in log._names("parts") if n.startswith("part=")} == set(parts)


def test_compactions_do_not_race(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"))
    log.append(rows(spark, 0, 20, 0, "a"))
    other = ResultLog(spark, str(tmp_path / "log"))
    stale = other.manifest
    log.compact()
    want = state(log)
    other.manifest = lambda: {"version": 0, "snapshot": [], "covered": []}
    with pytest.raises(Exception, match="exist"):
        other.compact()
    other.manifest = stale
    assert state(other) == want
    log.vacuum()  # what the failed one left goes too
    assert state(log) == want and len(log._names("parts")) == len(log.parts()) + sum(n.startswith("_") for n in log._names("parts"))


def test_unfinished_writes_are_not_read(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"))
    log.append(rows(spark, 0, 5, 0, "a"))
    want = state(log)
    rows(spark, 0, 5, 1, "b").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("model").parquet(
        str(tmp_path / "log" / "parts" / "part=delta-open")
    )
    assert state(log) == want


def test_lookups_read_the_parts_that_may_hold_a_key(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"), part_keys=50)
    log.append(rows(spark, 0, 400, 0, "a"))
    log.compact()
    log.append(rows(spark, 1000, 1020, 1, "b"))
    parts = log.parts()
    assert len(parts) >= 12

    def keys(*names):
        return spark.createDataFrame([(n,) for n in names], "key string")

    assert log.parts_for("m", keys("absent")) == [] or len(log.parts_for("m", keys("absent"))) <= 2
    for name in ("k7", "k399", "k1011"):
        few = log.parts_for("m", keys(name, name))
        assert 1 <= len(few) <= 3
        got = log.get("m", now(), keys(name)).filter(F.col("key") == name)
        assert got.count() == 1 and len(got.inputFiles()) < len(log.get("m", now()).inputFiles()) / 2
    assert len(log.parts_for("none", keys("k7"))) <= 2  # another model's key
    everything = keys(*[f"k{k}" for k in range(400)])
    assert len(log.parts_for("m", everything)) >= len(parts) - 3
    assert log.parts_for("m", keys()) == []
    # a part without a filter is always read
    log._delete(f"filters/of={[p for p in parts if p.startswith('delta-')][0]}")
    assert [p for p in parts if p.startswith("delta-")][0] in log.parts_for("m", keys("absent"))


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(5)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 20_000)
    packed = filter_bits(hashes)
    assert all(filter_hits(packed, hashes[k : k + 1]) for k in range(0, 20_000, 37))
    others = rng.integers(-(1 << 63), (1 << 63) - 1, 2000)
    assert sum(filter_hits(packed, others[k : k + 1]) for k in range(2000)) <= 60
    assert filter_hits(filter_bits(np.array([1])), np.array([1])) and not filter_hits(filter_bits(np.zeros(0, np.int64)), np.array([1]))


def test_a_snapshot_has_as_many_parts_as_its_keys_ask_for(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"), part_keys=40)
    for step in range(3):
        log.append(rows(spark, 0, 40, step, f"w{step}-").unionByName(rows(spark, 0, 40, step + 10, f"x{step}-")))
    before = state(log)
    log.compact()
    assert 1 <= len(log.manifest()["snapshot"]) <= 2  # 80 keys of 480 writes
    assert state(log) == before
