"""Series operators against numpy, with small blocks and series longer than a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.operators import series as S
from sonarium.operators import segments as G

BITS = 4


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(7)
    arrays = {"long": rng.normal(size=700), "short": rng.normal(size=5), "one": np.array([0.5])}
    rows = [(c, i, float(x)) for c, a in arrays.items() for i, x in enumerate(a)]
    return arrays, spark.createDataFrame(rows, "clip string, i long, x double").repartition(6)


def arrays_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["clip"], {})[r["i"]] = r["x"]
    return {c: np.array([v[i] for i in sorted(v)]) for c, v in out.items()}


def box(a, win):
    return np.convolve(a, np.ones(win) / win, mode="same")


def test_smooth_centered(waves):
    arrays, df = waves
    got = arrays_of(S.smooth_centered(df, BITS))
    np.testing.assert_allclose(got["long"], box(arrays["long"], 11), atol=1e-9)  # 700 div 64 = 10, made odd
    np.testing.assert_allclose(got["short"], box(arrays["short"], 3), atol=1e-9)
    assert got["one"] == pytest.approx([0.5 / 3])


def test_smoothing_stays_local(spark):
    """A NaN, and samples of 1e17 and 1e7, touch only the windows that hold them."""
    x = np.random.default_rng(8).normal(size=400)
    for odd in (float("nan"), 1e17, 1e7):
        y = x.copy()
        y[150] = odd
        df = S.series_from_arrays(spark.createDataFrame([("c", y.tolist()), (None, x.tolist())], "clip string, w array<double>"), "clip", "w")
        got = arrays_of(S.smooth_centered(df, bits=4))
        want = np.array([y[max(0, i - 3) : i + 4].sum() / 7 for i in range(400)])
        np.testing.assert_allclose(got["c"], want, rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(got[None], box(x, 7), atol=1e-12)
        late = arrays_of(S.smooth_trailing(df, 1.0, bits=4))["c"]
        np.testing.assert_allclose(late, [y[max(0, i - 3) : i + 1].mean() for i in range(400)], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("smooth", [S.smooth_centered, S.smooth_trailing])
def test_smoothing_adds_up_each_sample_once(spark, smooth):
    """No window frame reaches to the end of its partition: Spark adds such a frame up anew for every row, quadratic in a block."""
    series = spark.range(3000).select(F.lit("c").alias("clip"), F.col("id").alias("i"), F.sin("id").alias("x"))
    plan = smooth(series, bits=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$()" in plan and "unboundedfollowing$()" not in plan.replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")


@pytest.mark.parametrize("strength", [0.0, 0.5, 1.0])
def test_smooth_trailing(waves, strength):
    arrays, df = waves
    got = arrays_of(S.smooth_trailing(df, strength, BITS))
    for c, a in arrays.items():
        win = max(1, int(len(a) / 100 * (0.1 + 0.9 * strength)))
        want = [a[max(0, i - win + 1): i + 1].mean() for i in range(len(a))]
        np.testing.assert_allclose(got[c], want, atol=1e-9)


def test_saliency_series(waves):
    arrays, df = waves
    got = arrays_of(S.saliency_series(df, BITS))
    s = box(arrays["long"], 11)
    p = np.percentile(s, 95)
    s = np.clip(s, 0, p)
    np.testing.assert_allclose(got["long"], (s - s.min()) / (s.max() - s.min() + 1e-9), atol=1e-9)


def test_clip_display_zero_cap(spark):
    df = spark.createDataFrame([("z", i, 0.0) for i in range(4)] + [("z", 4, 3.0)], "clip string, i long, x double")
    assert arrays_of(S.clip_display(df, 50.0))["z"].tolist() == [0, 0, 0, 0, 1.0]


def test_peak_sanitize_and_scale(spark):
    values = [float("nan"), 4.0, float("inf"), -8.0, 1.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(values)] + [("q", 0, 0.0)], "clip string, i long, x double")
    clean = S.sanitize(df)
    assert arrays_of(S.peak_normalize(clean))["a"].tolist() == [0, 0.5, 0, -1, 0.125]
    assert arrays_of(S.peak_normalize(clean, 100.0))["a"].tolist() == [0, 4, 0, -8, 1]
    assert arrays_of(S.absmax_scale(clean))["q"].tolist() == [0.0]
    assert {r["clip"]: r["bad"] for r in S.bad_samples(df).collect()} == {"a": 2, "q": 0}


def test_silent_runs_and_dither(spark):
    x = [1.0] + [0.0] * 30 + [1.0] + [0.0] * 9 + [1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", 0, 0.0)], "clip string, i long, x double")
    runs = S.silent_runs(df, rate=10, bits=BITS).collect()
    assert [(r["clip"], r["start"], r["end"], r["samples"]) for r in runs] == [("a", 1, 30, 30)]
    noisy = arrays_of(S.dither_silence(df, rate=10, bits=BITS))
    assert noisy["b"].tolist() == [0.0]
    changed = np.flatnonzero(noisy["a"] != x)
    assert changed.tolist() == list(range(1, 31)) and np.abs(noisy["a"][1:31]).max() < 1e-3


def test_rms_downsample(waves):
    arrays, df = waves
    got = {(r["clip"], r["point"]): r["rms"] for r in S.rms_downsample(df, 300, BITS).collect()}
    want = np.sqrt((arrays["long"][:600].reshape(300, 2) ** 2).mean(axis=1))
    assert len(got) == 300  # the short clips have no whole block
    np.testing.assert_allclose([got["long", k] for k in range(300)], want)


def test_frame_features(waves):
    arrays, df = waves
    got = {r["clip"]: r for r in S.frame_features(df, 100, 64, 16, centred=False, bits=BITS).collect()}
    for c, a in arrays.items():
        padded = np.pad(a, (0, max(0, 64 - len(a))))
        frames = np.lib.stride_tricks.sliding_window_view(padded, 64)[::16]
        rms = np.sqrt((frames**2).mean(axis=1))
        assert got[c]["rms_energy_mean"] == pytest.approx(rms.mean()) and got[c]["rms_energy_std"] == pytest.approx(rms.std(), abs=1e-9)
    frames = np.lib.stride_tricks.sliding_window_view(arrays["long"], 64)[::16] < 0
    zcr = (frames[:, 1:] != frames[:, :-1]).sum(axis=1) / 64
    assert got["long"]["zero_crossing_rate_mean"] == pytest.approx(zcr.mean())
    assert got["long"]["zero_crossing_rate_max"] == pytest.approx(zcr.max())
    assert got["long"]["duration"] == 7.0 and got["long"]["sample_rate"] == 100


def test_centred_frames(waves):
    arrays, df = waves
    got = {r["clip"]: r for r in S.frame_features(df, 100, 64, 16, bits=BITS).collect()}
    for c, a in arrays.items():
        frames = np.lib.stride_tricks.sliding_window_view(np.pad(a, 32), 64)[::16]
        rms = np.sqrt((frames**2).mean(axis=1))
        assert got[c]["rms_energy_mean"] == pytest.approx(rms.mean()) and got[c]["rms_energy_min"] == pytest.approx(rms.min())
        edge = np.lib.stride_tricks.sliding_window_view(np.pad(a, 32, mode="edge"), 64)[::16] < 0
        zcr = (edge[:, 1:] != edge[:, :-1]).sum(axis=1) / 64
        assert got[c]["zero_crossing_rate_mean"] == pytest.approx(zcr.mean())


def test_segments(spark, waves):
    arrays, df = waves
    long = df.filter("clip = 'long'")
    durations = spark.createDataFrame([("long", 14.0)], "clip string, duration double")
    words = [(0, 0.0, 1.0), (1, 2.0, 2.001), (2, 13.0, 14.0), (3, -1.0, 2.0), (4, 5.0, 5.0), (5, 13.0, 14.5)]
    segs = spark.createDataFrame([("long", s, a, b, "w") for s, a, b in words], "clip string, seg long, start double, end double, word string")
    got = {r["seg"]: r["saliency"] for r in G.score_word_segments(long, segs, durations).collect()}
    a = arrays["long"]
    want = {0: a[0:50].mean(), 1: a[100:101].mean(), 2: a[650:700].mean()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    none = G.score_segments(long, segs.filter("seg >= 3"), durations).collect()
    assert len(none) == 28 and {r["word"] for r in none} >= {"segment_1", "segment_28"}
    assert G.score_uniform_segments(long, durations, 32).count() == 32


def test_intensity_by_rank(spark):
    rows = [("z", s, 0.0, 1.0, "w", v) for s, v in enumerate([0.0, 2e-10, 0.0, -3e-10])]
    df = spark.createDataFrame(rows, "clip string, seg long, start double, end double, word string, saliency double")
    got = {r["seg"]: r["intensity"] for r in G.segment_intensity(df).collect()}
    assert got == pytest.approx({3: 1.0, 1: 1 - 0.225, 0: 1 - 0.45, 2: 1 - 0.675})


def test_chunk_crop_and_times(spark):
    df = spark.createDataFrame([("a", i, 0.0) for i in range(7)], "clip string, i long, x double")
    rows = S.tumbling_chunks(df, rate=1, seconds=3).orderBy("i").collect()
    assert [(r["chunk"], r["offset_s"]) for r in rows] == [(0, 0.0)] * 3 + [(1, 3.0)] * 3 + [(2, 6.0)]
    chunks = df.select("clip", (F.col("i") * 2.0).alias("start"))
    assert S.crop_chunks(chunks, 6.0).count() == 3


@pytest.mark.parametrize("gaps", [False, True])
def test_segment_means_over_blocks(spark, gaps):
    """Segments of all lengths that overlap, over several blocks; odd values touch only the segments that cover them."""
    rng = np.random.default_rng(9)
    n = 9000
    x = rng.standard_normal(n)
    x[[700, 8000]], x[4100], x[5000] = np.nan, 1e17, np.inf
    null = set(rng.choice(n, 40 if gaps else 0, replace=False).tolist())
    frames = spark.createDataFrame([("a", i, None if i in null else float(v)) for i, v in enumerate(x)], "clip string, i long, x double").repartition(5)
    lengths = rng.choice([1, 2, 15, 16, 17, 100, 255, 256, 300, 4096, 6000], 400)
    starts = rng.integers(0, n - 1, 400)
    segs = [("a", k, float(s), float(min(n, s + l)), "w") for k, (s, l) in enumerate(zip(starts, lengths))]
    df = spark.createDataFrame(segs, "clip string, seg long, start double, end double, word string").repartition(3)
    got = {r["seg"]: r["saliency"] for r in G.score_word_segments(frames, df, spark.createDataFrame([("a", float(n))], "clip string, duration double")).collect()}
    for _, k, a, b, _ in segs:
        part = [x[i] for i in range(int(a), int(b)) if i not in null]
        if not part:
            assert k not in got
        else:
            assert got[k] == pytest.approx(np.mean(part), rel=1e-9, abs=1e-12, nan_ok=True), (a, b)
    covers = df.select("seg", F.inline(G.covering_nodes(F.col("start").cast("long"), F.col("end").cast("long")))).filter("low < high").collect()
    size = {}
    for r in covers:
        size.setdefault(r.seg, [0, set()])[0] += r.high - r.low
        for node in range(r.low, r.high):
            here = set(range(node << 2 * r.level, (node + 1) << 2 * r.level))
            assert not here & size[r.seg][1]  # no frame twice
            size[r.seg][1] |= here
    for _, k, a, b, _ in segs:
        assert size[k][1] == set(range(int(a), int(b))) and size[k][0] <= 6 * 7
