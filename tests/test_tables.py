"""Sources, the result log and streams."""

import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sonarium.operators import embed as E
from sonarium.operators import profile as P
from sonarium.operators import queue as Q
from sonarium.sources.audio import audio_files, clip_info, encode_wav, list_clips, read_waves
from sonarium.sources.datasets import DatasetTable
from sonarium.sources.metadata import read_metadata
from sonarium.sources.results import ResultLog
from sonarium.streaming import sessions as S
from sonarium.streaming.arrivals import latest_result_stream, read_drops
from sonarium.operators.results import latest_results, score, visible_results


def test_read_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text(' Filename , Text\nA.wav ," Hello ""you"", all "\nb.wav,\n', encoding="utf-8")
    df = read_metadata(spark, str(tmp_path / "m.csv"))
    assert df.dtypes == [("filename", "string"), ("text", "string")]
    assert [tuple(r) for r in df.collect()] == [("A.wav", 'Hello "you", all'), ("b.wav", "")]


def test_metadata_white_space_and_line_breaks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('\ta ,b\n"\tx \n y\t", \xa0z\n', encoding="utf-8")
    rows = read_metadata(spark, str(tmp_path / "m.csv")).collect()
    assert [tuple(r) for r in rows] == [("x \n y", "z")]


def test_audio_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    with wave.open(str(tmp_path / "sub" / "tone.WAV"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.zeros(2 * 12000, dtype="<i2").tobytes())
    (tmp_path / "broken.mp3").write_bytes(b"not audio")
    (tmp_path / "notes.txt").write_text("x")
    clips = {r["filename"]: r for r in list_clips(spark, str(tmp_path)).collect()}
    assert set(clips) == {"tone.WAV", "broken.mp3"} and clips["tone.WAV"]["media_type"] == "audio/wav"
    assert "content" not in list_clips(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    info = {r["path"].rsplit("/", 1)[1]: (r["duration"], r["sample_rate"], r["channels"]) for r in clip_info(audio_files(spark, str(tmp_path))).collect()}
    assert info == {"tone.WAV": (1.5, 8000, 2), "broken.mp3": (0.0, 0, 0)}


def test_wave_round_trip(spark, tmp_path):
    x = np.sin(np.arange(400) / 9) * 0.7
    df = spark.createDataFrame([(x.tolist(), 8000)], "wave array<double>, rate int")
    (tmp_path / "x.wav").write_bytes(df.select(encode_wav("wave", "rate").alias("c")).first()["c"])
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    rows = read_waves(audio_files(spark, str(tmp_path))).collect()
    read = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    assert read["bad.wav"]["wave"] is None and read["x.wav"]["rate"] == 8000
    np.testing.assert_allclose(read["x.wav"]["wave"], x, atol=1e-4)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_waves_of_any_width_and_channels(spark, tmp_path, width):
    sides = np.array([[0.0, 0.0, 0.0, 0.0], [0.5, -0.25, 0.75, -1.0]])
    whole = np.round(sides.T * 2 ** (8 * width - 1)).astype("int64").clip(-(2 ** (8 * width - 1)), 2 ** (8 * width - 1) - 1)
    raw = b"".join(int(v + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for v in whole.ravel())
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(width), w.setframerate(8000)
        w.writeframes(raw)
    files = audio_files(spark, str(tmp_path))
    np.testing.assert_allclose(read_waves(files, every_channel=True).first()["wave"], sides, atol=0.01)
    np.testing.assert_allclose(read_waves(files).first()["wave"], sides.mean(axis=0), atol=0.01)


def test_failing_rows_get_null(spark):
    def make():
        def predict(v):
            if (v < 0).any():
                raise ValueError("negative")
            return v.sum(axis=1)

        return predict

    df = spark.createDataFrame([(k, [float(k), -1.0 if k == 2 else 1.0]) for k in range(4)], "id long, v array<double>")
    scored = score(df, make, ["v"], "s", DoubleType(), input_shapes=[[2]])
    assert {r["id"]: r["s"] for r in scored.collect()} == {0: 1.0, 1: 2.0, 2: None, 3: 4.0}


def test_dataset_table(spark):
    t = DatasetTable(spark, "datasets_under_test")

    def files(*names):
        rows = [(n, 1.5, 16000, 10, k) for k, n in enumerate(names)]
        df = spark.createDataFrame(rows, "original_filename string, duration double, sample_rate int, size long, arrival long")
        return df.withColumn("uploaded_at", F.current_timestamp())

    t.create("s:1", "it's")
    with pytest.raises(ValueError, match="already"):
        t.create("s:1", "it's")
    with pytest.raises(ValueError, match="does not exist"):
        t.append("s:1", "other", files("a.wav"))
    t.append("s:1", "it's", files("a.wav", "a.wav", "b.wav"))
    t.append("s:1", "it's", files("a.wav"))
    held = t.read("s:1", "it's").orderBy("arrival").collect()
    assert [r["filename"] for r in held] == ["a.wav", "a_1.wav", "b.wav", "a_2.wav"]
    assert held[3]["original_filename"] == "a.wav"
    t.create("s:1", "two")
    t.create("s2", "two")
    assert t.delete("s2", "none") is False and t.delete("s2", "two") is True
    assert t.delete_session("s:1") == 2 and t.read("s:1", "it's").count() == 0


def test_result_log(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "log"))

    def at(text):
        return F.lit(text).cast("timestamp")

    def put(key, payload, model, when, seq=0, kind="prediction"):
        log.put(spark.createDataFrame([(key, payload)], "key string, payload string"), model, kind, at(when), seq)

    put("k", "initial", "whisper", "2024-01-01 00:00:00")
    put("k", "updated", "whisper", "2024-01-01 00:00:00", seq=1)
    put("k", "happy", "emotion", "2024-01-01 00:00:00", kind="embedding")
    put("late", "long", "whisper", "2024-01-01 00:00:00", kind="embedding")
    put("late", "short", "whisper", "2024-01-01 01:00:00")

    def read(model, when):
        return {r["key"]: r["payload"] for r in log.get(model, at(when)).collect()}

    assert read("whisper", "2024-01-01 05:59:59") == {"k": "updated", "late": "short"}
    assert read("whisper", "2024-01-01 06:00:00") == {"late": "short"}
    assert read("whisper", "2024-01-01 07:00:00") == {}  # the expired last write hides the longer-lived one
    assert read("emotion", "2024-01-01 23:00:00") == {"k": "happy"}


def test_results_live_as_long_as_their_writer_says(spark):
    rows = [("m", "week", "p", 0, 7 * 86400), ("m", "hour", "p", 0, 3600)]
    log = spark.createDataFrame(rows, "model string, key string, payload string, seq long, ttl_s int")
    log = log.withColumn("written_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    two_days_on = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert [r["key"] for r in visible_results(log, two_days_on).collect()] == ["week"]


def test_failures_are_tried_again(spark, tmp_path):
    """A log that does not exist yet, a model that fails on some rows, then the mended model."""
    log = ResultLog(spark, str(tmp_path / "none" / "scores"))
    files = spark.createDataFrame([(k, [float(k)]) for k in range(4)], "id long, v array<double>")
    assert log.get("m").count() == 0

    def failing():
        def predict(x):
            if (x > 1).any():
                raise ValueError("too large")
            return x.sum(axis=1)

        return predict

    def mended():
        return lambda x: x.sum(axis=1)

    got = {r["id"]: r["score"] for r in log.score(files, "id", "m", failing, ["v"], [[1]]).collect()}
    assert got == {"0": 0.0, "1": 1.0, "2": None, "3": None} and log.log().count() == 2
    got = {r["id"]: r["score"] for r in log.score(files, "id", "m", mended, ["v"], [[1]]).collect()}
    assert got == {str(k): float(k) for k in range(4)} and log.log().count() == 4


def test_score_and_store(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "scores"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    log.put(spark.createDataFrame([("1", "99.0")], "key string, payload string"), "sum", now=now)
    files = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(4)], "id long, v array<double>")

    def make():
        return lambda x: x.sum(axis=1)

    for _ in range(2):  # the second round reads everything from the log
        scored = log.score(files, "id", "sum", make, ["v"], [[2]], now=now)
        assert {r["id"]: r["score"] for r in scored.collect()} == {"0": 1.0, "1": 99.0, "2": 3.0, "3": 4.0}
    assert log.log().count() == 4


COMMANDS = "session_id long, seq long, op string, key string, value string, at timestamp"


def commands(spark):
    rng = np.random.default_rng(5)
    ops = rng.choice(["add", "add", "add", "progress", "clear"], 120, p=[0.3, 0.3, 0.2, 0.15, 0.05])
    rows = [(int(s), k, str(op), f"p{k % 2}", f"v{k}") for k, (s, op) in enumerate(zip(rng.choice([1, 1, 1, 2], 120), ops))]
    df = spark.createDataFrame(rows, "session_id long, seq long, op string, key string, value string")
    return df.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))


def test_queue_stream_matches_batch(spark, tmp_path):
    cmds = commands(spark)
    for part in range(3):  # three micro-batches, in order
        cmds.filter((F.col("seq") >= part * 40) & (F.col("seq") < part * 40 + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_drops(spark, str(tmp_path / "in"), cmds.schema, files_per_batch=1)
    q = S.queue_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    q.trigger(availableNow=True).start().awaitTermination()
    now = S.queue_now(spark.read.schema(S.QUEUE_OUT).parquet(str(tmp_path / "out")))
    got = sorted((r["session_id"], r["position"], r["item"]) for r in now.collect())
    want = sorted((r["session_id"], r["position"], r["item"]) for r in Q.queue_items(cmds).collect())
    assert got == want and want


@pytest.mark.parametrize("cuts", [1, 2, 4])
def test_idle_sessions_start_anew(spark, tmp_path, cuts):
    days = [0, 0.5, 7, 7.2, 8.2, 8.3, 20, 20.1]
    rows = [(1, k, "add", "k", f"v{k}") for k in range(len(days))] + [(2, 100 + k, "progress" if k else "add", "k", f"w{k}") for k in range(3)]
    at = {k: d for k, d in enumerate(days)} | {100: 0, 101: 0.9, 102: 1.8}
    df = spark.createDataFrame([(*r, float(at[r[1]])) for r in rows], "session_id long, seq long, op string, key string, value string, d double")
    cmds = df.withColumn("at", F.timestamp_micros((F.col("d") * 86_400_000_000).cast("long") + 1_700_000_000_000_000)).drop("d")
    want = [(1, 0, "v6"), (1, 1, "v7"), (2, 0, "w0")]
    assert sorted(map(tuple, Q.queue_items(cmds).collect())) == want
    size = -(-len(days) // cuts)
    for part in range(cuts):
        own = (F.col("seq") % 100 >= part * size) & (F.col("seq") % 100 < (part + 1) * size)
        cmds.filter(own).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_drops(spark, str(tmp_path / "in"), cmds.schema, files_per_batch=1)
    q = S.queue_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    q.trigger(availableNow=True).start().awaitTermination()
    now = S.queue_now(spark.read.schema(S.QUEUE_OUT).parquet(str(tmp_path / "out")))
    assert sorted((r["session_id"], r["position"], r["item"]) for r in now.collect()) == want


def test_latest_stream_replay(spark, tmp_path):
    rows = [("m", k % 7, k, f"p{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "model string, key long, seq long, payload string").withColumn("written_at", F.timestamp_seconds("seq"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    for name in ("ck1", "ck2"):  # running the whole stream again overwrites the same batches
        stream = read_drops(spark, str(tmp_path / "in"), df.schema, files_per_batch=2)
        latest_result_stream(stream, str(tmp_path / "log"), str(tmp_path / name)).awaitTermination()
    got = latest_results(spark.read.parquet(str(tmp_path / "log")).drop("batch_id"))
    assert {r["key"]: r["payload"] for r in got.collect()} == {k: f"p{max(j for j in range(50) if j % 7 == k)}" for k in range(7)}


def test_session_spans(spark):
    hours = [0, 1, 24, 48.5, 72.4, 96.4]
    df = spark.createDataFrame([(1, h * 3600.0) for h in hours], "session_id long, s double").withColumn("at", F.timestamp_seconds("s"))
    spans = [(r["span"], r["touches"]) for r in Q.session_spans(df, F.col("at")).orderBy("span").collect()]
    assert spans == [(0, 3), (1, 2), (2, 1)]


def test_short_lifetimes(spark):
    df = spark.createDataFrame([(1, m * 60.0) for m in (0, 5, 50, 52)], "session_id long, s double").withColumn("at", F.timestamp_seconds("s"))
    spans = [(r["span"], r["touches"]) for r in Q.session_spans(df, F.col("at"), ttl_s=600).orderBy("span").collect()]
    assert spans == [(0, 2), (1, 2)]


def test_histogram_edges(spark):
    values = np.round(np.random.default_rng(2).random(2000) * 7 - 3, 2)
    long = spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")
    got = [r["count"] for r in P.histogram(long).orderBy("bin").collect()]
    assert got == np.histogram(values, 10)[0].tolist()


def test_pca_leaves_unusable_rows_out(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=2).tolist()) for k in range(20)] + [(20, None), (21, [1.0, None]), (22, []), (23, [float("nan"), 0.0])]
    got = E.pca(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", k=5).collect()
    assert sorted(r["id"] for r in got) == list(range(20)) and all(len(r["coordinates"]) == 2 for r in got)
