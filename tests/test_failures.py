"""Rows a model or a perturbation cannot work on keep their own error, and the others go on."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sonarium.operators import labels, results, robust


def models():
    """Model factories as closures, which travel to the workers by value."""

    def odd_only():
        def predict(xs):
            for x in xs:
                if x % 2 == 0:
                    raise ValueError(f"{int(x)} is even")
            return np.asarray(xs) * 0.5

        return predict

    def unloadable():
        raise OSError("no weights")

    def nameless():
        def predict(xs):
            raise KeyError

        return predict

    return odd_only, unloadable, nameless


def test_errors_of_single_rows(spark):
    odd_only, unloadable, nameless = models()
    df = spark.range(40).withColumns({"error": F.lit("old"), "_p": F.lit(1)}).repartition(3)
    got = {r["id"]: (r["score"], r["error"]) for r in results.score_or_error(df, odd_only, ["id"], "score", DoubleType()).collect()}
    assert got == {k: (None, f"{k} is even") if k % 2 == 0 else (k * 0.5, None) for k in range(40)}
    for model, text in ((unloadable, "no weights"), (nameless, "KeyError")):
        got = results.score_or_error(df, model, ["id"], "score", DoubleType()).collect()
        assert len(got) == 40 and {(r["score"], r["error"]) for r in got} == {(None, text)}
    assert results.score_or_error(df.limit(0), odd_only, ["id"], "score", DoubleType()).count() == 0


def test_fallback_carries_the_scorers_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], None), (2, None, "bad file"), (3, [], None), (4, [1.0], "half read")], "id int, l array<double>, why string")
    got = {r["id"]: (r["predicted_label"], r["confidence"], r["fallback"], r["error"]) for r in labels.predict_labels(df, "l", ("a", "b"), "why").collect()}
    assert got[2] == ("unknown", 0.0, True, "bad file") and got[3] == ("unknown", 0.0, True, "no logits") and got[4] == ("unknown", 0.0, True, "half read")
    assert got[1][0] == "b" and got[1][2:] == (False, None)
    assert {r["error"] for r in labels.predict_labels(df, "l", ("a", "b")).collect()} == {None, "no logits"}


def test_arrays_of_scores(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [-1.0]), (3, None)], "id int, v array<double>")

    def twice():
        return lambda vs: [2 * np.asarray(v) if v[0] > 0 else 1 / 0 for v in vs]

    got = {r["id"]: (r["o"], r["e"]) for r in results.score_or_error(df, twice, ["v"], "o", ArrayType(DoubleType()), "e").collect()}
    assert got[1] == ([2.0, 4.0], None) and got[2] == (None, "division by zero") and got[3][0] is None and "NoneType" in got[3][1]


def test_chain_fails_per_file(spark):
    wave = [float(np.sin(k)) for k in range(64)]
    df = spark.createDataFrame([(1, wave, 16000), (2, None, 16000), (3, [], 16000), (4, wave, None), (5, wave, 0)], "clip int, wave array<double>, rate int")
    chain = [{"type": "time_masking", "params": {"mask_start_percent": 0, "mask_end_percent": 50}}, {"type": "frequency_masking"}, {"type": "warp"}]
    got = {r["clip"]: r for r in robust.perturb_chain(df, chain, floor=0.0).collect()}
    status = {k: [(s["status"], s["error"]) for s in r["applied_perturbations"]] for k, r in got.items()}
    last = ("unsupported", None)
    assert status[1] == [("applied", None), ("applied", None), last]
    assert status[2] == status[3] == [("failed", "no samples")] * 2 + [last]
    assert status[4] == status[5] == [("applied", None), ("failed", "no sample rate"), last]
    assert got[2]["wave"] is None and got[3]["wave"] == [] and got[4]["wave"] == [0.0] * 32 + wave[32:] == got[5]["wave"]
