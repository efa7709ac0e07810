"""Expressions and row-level operators on hand-made cases."""

import difflib
import random
import re
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonarium.functions import rows as R
from sonarium.functions import signal as N
from sonarium.functions import text as T
from sonarium.operators import accuracy, attention, catalog, embed, labels, lookup, profile, robust
from sonarium.operators.terms import term_counts, term_tokens, top_terms

PAIRS = [
    ("a", "The quick, brown fox!", "the quick brown fox"),
    ("b", "", "some words here"),
    ("c", "words", ""),
    ("d", "words", None),
    ("e", "!!!", "..."),
    ("f", "Élan vital naïve", "elan vital naive"),
    ("g", "one two three four", "five six seven"),
    ("h", "x " * 150 + "tail", "x " * 140 + "y " * 12 + "tail"),
    ("i", "kitten sat", "sitting sat on"),
    ("j", "...", "a b"),
]


def clean(t):
    t = t.lower().translate(str.maketrans("", "", string.punctuation))
    return re.sub(r"\s+", " ", t).strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_accuracy_metrics(spark):
    df = spark.createDataFrame(PAIRS, "clip string, predicted string, truth string")
    got = {r["clip"]: r.asDict() for r in accuracy.transcript_accuracy(df).collect()}
    for clip, p, t in PAIRS:
        r = got[clip]
        if not t:
            assert all(r[m] is None for m in accuracy.METRICS[:6])
            assert (r["word_count_predicted"], r["word_count_truth"]) == (len(p.split()), 0)
            continue
        p, t = clean(p), clean(t)
        pw, tw = p.split(), t.split()
        assert r["levenshtein_distance"] == distance(p, t)
        assert r["character_error_rate"] == pytest.approx(min(distance(p, t) / len(t), 1) if t else float(bool(p)))
        assert r["word_error_rate"] == pytest.approx(min(distance(pw, tw) / len(tw), 1) if tw else float(bool(pw)))
        assert r["accuracy_percentage"] == pytest.approx(difflib.SequenceMatcher(None, pw, tw).ratio() * 100)
        assert r["character_similarity"] == pytest.approx(difflib.SequenceMatcher(None, p, t).ratio() * 100)
        assert r["exact_match"] == float(p == t)
        assert (r["word_count_predicted"], r["word_count_truth"]) == (len(pw), len(tw))


def test_similarity_holds_one_pair():
    """A batch of pairs does not become a batch of Python strings or word lists."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 9000, 200)) for _ in range(400)]
    a, b = pa.array([*texts, None, ""]), pa.array([*texts[1:], texts[0], "x", ""])
    tracemalloc.start()
    got = T.word_ratio.func(a, b).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [None if x is None else difflib.SequenceMatcher(None, x.split(), y.split()).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())]
    assert peak < 1_000_000
    assert T.text_ratio.func(a[-2:], b[-2:]).to_pylist() == [None, 1.0]


def test_similarity_sends_two_texts(spark):
    df = spark.createDataFrame(PAIRS, "clip string, predicted string, truth string")
    plan = accuracy.transcript_accuracy(df, metrics=("accuracy_percentage", "character_similarity"))._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "EvalPython" in line]
    assert len(sent) == 1 and "ratio(_pw" not in sent[0] and "word_ratio(_p" in sent[0] and "text_ratio(_p" in sent[0]


def test_wide_distances(spark):
    """Short, near and far pairs, of characters and of many distinct words, agree with the plain matrix."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcé "), n)) for n in (0, 1, 40, 700, 900)]
    near = texts[4][:300] + "zz" + texts[4][310:]
    pairs = [(x, y) for x in texts for y in [*texts, near]]
    df = spark.createDataFrame([(x, y) for x, y in pairs], "a string, b string")
    got = accuracy.with_distance(df, "a", "b", "d", T.near_char_distance).collect()
    assert all(r["d"] == distance(r["a"], r["b"]) for r in got)
    lists = [[f"w{k}" for k in rng.integers(0, 900, n)] for n in (0, 3, 300, 800)]
    df = spark.createDataFrame([(x, y) for x in lists for y in lists], "a array<string>, b array<string>")
    got = accuracy.with_distance(df, "a", "b", "d", T.near_word_distance).collect()
    assert all(r["d"] == distance(r["a"], r["b"]) for r in got)
    assert T.edit_distance("kitten", "sitting") == 3 and T.edit_distance("", "ab") == 2 and T.edit_distance("abab", "ab") == 2


def test_terms_tie_order(spark):
    df = spark.createDataFrame([(2, "zeta zeta alpha"), (1, "(beta), the BETA alpha ab"), (3, ""), (4, None)], "doc_id long, text string")
    top = [(r["term"], r["count"]) for r in top_terms(term_counts(term_tokens(df))).collect()]
    assert top == [("beta", 2), ("alpha", 2), ("zeta", 2)]  # equal counts: first seen first


def test_metadata_helpers(spark):
    df = spark.createDataFrame(
        [("custom:s1:a:b", "03-01-05-01-01.wav", "MFCC-7", 0), ("custom:s1", "x/Y\\joyful.MP3", "chroma_21", 1536), ("CV-valid-dev", "noext", "", 3 * 1024**3)],
        "ref string, path string, feature string, size long",
    )
    r = df.select(
        R.dataset_ref(F.col("ref")).alias("d"), R.label_from_filename(F.col("path")).alias("l"), R.label_from_position(F.col("path")).alias("p"),
        R.media_type(F.col("path")).alias("m"), R.describe_feature(F.col("feature")).alias("x"), R.human_size(F.col("size")).alias("z"),
    ).collect()
    assert [tuple(x["d"]) for x in r] == [("custom", "s1", "a:b"), ("invalid", None, None), ("global", None, "common-voice")]
    assert [x["l"] for x in r] == ["neutral", "happy", None] and [x["p"] for x in r] == ["angry", None, None]
    assert [x["m"] for x in r] == ["audio/wav", "audio/mpeg", None]
    assert r[0]["x"].startswith("Seventh MFCC") and r[1]["x"].startswith("21st chroma") and r[2]["x"] == "Unknown audio feature."
    assert [x["z"] for x in r] == ["0 Bytes", "1.5 KB", "3 GB"]


def test_dedupe_skips_taken_suffixes(spark):
    names = ["a.wav", "a.wav", "a_1.wav", "a.wav", "a_3.wav", "a.wav", "b", "b", "a_1.wav"]
    df = spark.createDataFrame([("d", n, k) for k, n in enumerate(names)], "ds string, name string, k long")
    got = {r["k"]: r["filename"] for r in catalog.dedupe_filenames(df, ["ds"], "name", "k").collect()}
    assert [got[k] for k in range(9)] == ["a.wav", "a_1.wav", "a_1_1.wav", "a_2.wav", "a_3.wav", "a_4.wav", "b", "b_1", "a_1_2.wav"]


def in_turn(names):
    """Each name as it arrives, against the names given so far."""
    given = []
    for name in names:
        stem, dot, ext = name.partition(".")
        new, c = name, 1
        while new in given:
            new, c = f"{stem}_{c}{dot}{ext}", c + 1
        given.append(new)
    return given


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedupe_in_the_order_of_arrival(spark, seed):
    import random

    rng = random.Random(seed)
    pools = [["a.wav", "a_1.wav", "a_2.wav"], ["a", "a_1", "a_1_1", "a_2", "a_1_1_1", "b", "b_2"], [f"x_{k}.mp3" for k in range(1, 30)] + ["x.mp3"] * 20, ["q.wav"] * 5 + ["q_1.wav", "q_3.wav", "q_2_1.wav"]]
    sets = [(d, [rng.choice(rng.choice(pools)) for _ in range(rng.choice([1, 7, 60, 200]))]) for d in (None, "d1", "d2", "d3")]
    sets.append(("all", [rng.choice(pools[2]) for _ in range(300)]))
    rows, want, k = [], {}, 0
    for d, names in sets:
        for name, new in zip(names, in_turn(names)):
            k += rng.randint(1, 5000)
            rows.append((d, name, k))
            want[k] = new
    df = spark.createDataFrame(rows, "ds string, name string, k long").repartition(4)
    out = catalog.dedupe_filenames(df, ["ds"], "name", "k")
    assert {r["k"]: r["filename"] for r in out.collect()} == want
    assert out.columns == ["ds", "name", "k", "filename"]


def test_cohort_checks(spark):
    asked = spark.createDataFrame([(1,), (2,)], "id long")
    assert catalog.check_cohort(asked, asked.filter("id = 1"), "id").first().asDict() == {"requested": 2, "found": 1, "missing": 1}
    with pytest.raises(Exception, match="more than 1 files"):
        catalog.check_cohort(asked, asked, "id", max_files=1).collect()
    with pytest.raises(Exception, match="no files"):
        catalog.check_cohort(asked.limit(0), asked, "id").collect()


def test_ground_truth_prefix_and_nan(spark):
    meta = spark.createDataFrame([(0, "cv-valid-dev/x", "first"), (1, "x", None), (2, "x", "late"), (3, "cv-valid-dev/y", "why")], "row long, filename string, text string")
    files = spark.createDataFrame([("x",), ("y",), ("z",)], "filename string")
    got = {r["filename"]: r["ground_truth"] for r in lookup.attach_ground_truth(files, meta, "common-voice").collect()}
    assert got == {"x": "nan", "y": "why", "z": None}
    assert lookup.attach_ground_truth(files, meta, "custom").first()["ground_truth"] is None


def test_labels(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 5.0]), (3, None)], "f int, logits array<double>")
    got = {r["f"]: r for r in labels.predict_labels(df, "logits", ["n", "h"]).collect()}
    assert got[1]["predicted_label"] == "n" and got[2]["predicted_label"] == "2" and set(got[2]["probabilities"]) == {"n", "h", "emotion_2"}
    assert (got[3]["predicted_label"], got[3]["probabilities"], got[3]["fallback"]) == ("unknown", {"unknown": 1.0}, True)


def test_profile_flat_feature_and_zero_mean(spark):
    rows = [(1, {"flat": 2.0, "sym": -1.0}), (2, {"flat": 2.0, "sym": 1.0}), (3, {"flat": 2.0})]
    long = profile.melt(spark.createDataFrame(rows, "f int, m map<string,double>"), "f", "m")
    bins = {r["bin"]: r["count"] for r in profile.histogram(long).filter("feature = 'flat'").collect()}
    counts, _ = np.histogram([2.0, 2.0, 2.0], bins=10)
    assert [bins[k] for k in range(10)] == counts.tolist()
    ranked = profile.prevalence_rank(profile.feature_stats(long)).collect()
    assert [(r["feature"], r["stability_score"], r["prevalence_score"]) for r in ranked] == [("sym", 1.0, 0.5)]


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6)) @ np.diag([5, 4, 3, 1, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "f int, v array<double>")
    got = np.array([r["coordinates"] for r in embed.pca(df, "f", "v", 3).orderBy("f").collect()])
    c = x - x.mean(axis=0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:3].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(3)])
    np.testing.assert_allclose(got, c @ axes, atol=1e-9)
    assert embed.pca(df.limit(1), "f", "v", 2).count() == 0


def test_selection_geometry(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 0.1, 1.9), (4, 0.9, 1.9)], "id int, x double, y double")
    ell = [(0, 0), (2, 0), (2, 1), (1, 1), (0.5, 2), (0, 2)]
    assert sorted(r["id"] for r in embed.select_lasso(pts, "x", "y", ell).collect()) == [1, 2, 3]
    origin = spark.createDataFrame([([0.0, 0.0, 0.0],), ([1.0, 0.0],), ([1.0, 0.0, 1.0],)], "c array<double>")
    assert [r["angle"] for r in embed.select_by_angle(origin, "c", "xy").collect()] == pytest.approx([45.0])
    assert embed.axis_bounds(pts.limit(0), ["x"]).first().asDict() == {"x_low": 0.0, "x_high": 0.0}


def test_attention_edges(spark):
    cells = spark.createDataFrame(
        [("a", l, h, i, j, float(10 * l + h + i + j)) for l in range(2) for h in range(2) for i in range(2) for j in range(2)]
        + [("b", 6, 0, 0, 0, 9.0), ("b", 6, 3, 0, 0, 8.0), ("b", 0, 0, 0, 0, 7.0)],
        "clip string, layer int, head int, i int, j int, w double",
    )
    got = {(r["clip"], r["i"], r["j"]): r["w"] for r in attention.pick_head(cells, 6, 3).collect()}
    assert got == {("a", 0, 0): 0.0, ("a", 0, 1): 1.0, ("a", 1, 0): 1.0, ("a", 1, 1): 2.0, ("b", 0, 0): 8.0}
    zero = spark.createDataFrame([("z", 0, 0, 0.0), ("z", 0, 1, 0.0), ("z", 1, 0, 1.0), ("z", 1, 1, 1.0)], "clip string, i int, j int, w double")
    words = spark.createDataFrame([("z", 0, "u", 0.0, 0.2), ("z", 1, "v", 0.2, 0.4), ("z", 2, "w", 0.4, 0.6)], "clip string, idx long, word string, start double, end double")
    line = attention.attention_timeline(words, zero).orderBy("point").collect()
    assert len(line) == 6 and [r["attention_entropy"] for r in line[:3]] == [0.0] * 3
    assert line[5]["attention_entropy"] == pytest.approx(1.0, abs=1e-6) and line[5]["avg_incoming"] == 0.5
    assert attention.attention_pairs(words, zero).count() == 9


def test_perturbations(spark):
    wave = np.sin(2 * np.pi * 1500 * np.arange(1600) / 16000)
    df = spark.createDataFrame([("a", wave.tolist(), 16000)], "clip string, wave array<double>, rate int")
    noisy = np.array(df.select(N.add_noise(F.col("wave"), F.col("clip"), 0.1).alias("w")).first()["w"]) - wave
    assert abs(noisy.mean()) < 0.01 and abs(noisy.std() - 0.1) < 0.01
    half = np.array(df.select(N.mask_band(F.col("wave"), F.col("rate")).alias("w")).first()["w"])
    np.testing.assert_allclose(half, wave / 2, atol=1e-9)
    gone = np.array(df.select(N.mask_band(F.col("wave"), F.col("rate"), two_sided=True).alias("w")).first()["w"])
    np.testing.assert_allclose(gone, 0, atol=1e-9)
    chain = [{"type": "noise"}, {"type": "reverb"}, {"type": "noise", "params": {"noise_level": "x"}}]
    steps = robust.perturb_chain(df, chain).first()["applied_perturbations"]
    assert [s["status"] for s in steps] == ["applied", "unsupported", "failed"]
    assert steps[0]["params"] == {"noise_level": 0.005} and "x" in steps[2]["error"]
    done = robust.finish_perturbed(df.withColumn("path", F.lit("up/f.wav")), "path").first()
    assert done["duration_ms"] == 100 and re.fullmatch(r"f_perturbed_[0-9a-f]{8}\.wav", done["filename"])


def test_spectral_tone(spark):
    wave = np.sin(2 * np.pi * 1000 * np.arange(8000) / 16000)
    df = spark.createDataFrame([(wave.tolist(), 16000), ([0.0] * 10, 16000), ([], 16000)], "wave array<double>, rate int")
    rows = [r["s"] for r in df.select(N.spectral_features(F.col("wave"), F.col("rate")).alias("s")).collect()]
    assert rows[0]["spectral_centroid_mean"] == pytest.approx(1000, rel=0.02) and rows[0]["spectral_rolloff_max"] == pytest.approx(1000, rel=0.02)
    assert rows[1]["spectral_centroid_mean"] == 0.0 and rows[2]["spectral_centroid_mean"] is None


def test_edit_distance_by_bounds_and_by_matrix(monkeypatch):
    """Long pairs whose edits are as few as their symbols ask for need no matrix; all others agree with it."""
    rng = random.Random(5)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        b = list(a) if rng.random() < 0.7 else [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 5) if b else 0):
            k = rng.randrange(len(b))
            b[k : k + 1] = [b[k], rng.choice("abz")] if rng.random() < 0.5 else [rng.choice("az")]
        assert T.edit_distance(a, b) == T.edit_distance("".join(a), "".join(b)) == distance(a, b)

    def no_matrix(a, b):
        raise AssertionError("a matrix for a pair that its bounds settle")

    monkeypatch.setattr(T, "matrix_distance", no_matrix)
    text = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    kept = [w for k, w in enumerate(text) if k % 5]
    assert T.edit_distance(kept, text) == T.edit_distance(text, kept) == 4000
    assert T.edit_distance(" ".join(kept), " ".join(text)) == len(" ".join(text)) - len(" ".join(kept))
    odd = ["0zq0" if k % 11 == 10 else w for k, w in enumerate(text) if k % 7 != 6]
    assert T.edit_distance(odd, text) == 20_000 // 7 + 20_000 // 11 - 20_000 // 77
