"""Clean texts of any length pass the quality rules."""

import numpy as np

from sonarium.llm import quality


def test_long_clean_texts_are_kept(spark):
    rng = np.random.default_rng(7)
    kinds = np.array(["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(4000)])
    share = 1 / (np.arange(4000) + 20)

    def prose(n):
        return " ".join(rng.choice(kinds, n, p=share / share.sum()))

    sizes = [int(n) for n in rng.integers(40, 600, 300)] + [200_000, 400_000]
    rows = [(i, prose(n), "en", "s") for i, n in enumerate(sizes)]
    rows += [(1000, " ".join(f"{w}###" for w in prose(200).split()), "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert got[300] and got[301] and not got[1000]
    assert sum(got.values()) >= 0.98 * len(got)


def test_variety_reads_whole_texts(spark):
    words = [f"w{i % 300}" for i in range(1000)] + ["x"] * 500
    df = spark.createDataFrame([(" ".join(words),), ("",), (None,), ("a a b",)], "text string")
    got = [r._q.variety for r in quality.text_statistics(df).collect()]
    blocks = [words[k : k + quality.KINDS_BLOCK] for k in range(0, len(words), quality.KINDS_BLOCK)]
    want = sum(len(b) * np.log1p(len(set(b))) / np.log1p(len(b)) for b in blocks) / len(words)
    assert np.allclose(got, [want, 0, 0, np.log(3) / np.log(4)])
