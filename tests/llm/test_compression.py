"""Compression classifier: sizes against a plain loop, held-out accuracy on planted junk, labels it may not see, odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from support import CLASHING, prose

from sonarium.llm import compression

LABELS = "doc_id long, quality int, toxic int"


def junk(rng, n):
    kind = rng.randrange(4)
    text = prose(rng, n)
    if kind == 0:
        return text.upper().replace(" ", "!! ")
    if kind == 1:
        return text.replace(" ", " | ")
    if kind == 2:
        return " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in text.split())
    return " ".join(w for w in text.split() for _ in range(15))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(40, 300)) if i % 5 else junk(rng, rng.randint(40, 300)), i) for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4).cache()
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, _, _ in rows], LABELS)
    return docs, labels


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = compression.score_quality(docs, labels).collect()
    assert len(rows) == 1500 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    good = [r.predicted for r in held if r.doc_id % 5]
    bad = [r.predicted for r in held if r.doc_id % 5 == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.05


def test_held_out_labels_teach_nothing(labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(compression.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    plain, other = ({r.doc_id: r.score for r in compression.score_quality(docs, x).collect()} for x in (labels, turned))
    assert plain == other


def test_sizes_are_those_of_all_windows(spark):
    rng = random.Random(3)
    texts = [None, "", "a", prose(rng, 2000), "é" * 3000, prose(rng, 100_000)]
    good = compression.build_dictionary([prose(rng, 150).encode() for _ in range(200)])
    bad = b"tiny"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in compression.compressed_sizes(docs, good, bad).collect():
        raw = (texts[r.doc_id] or "").encode()
        pieces = [raw[i : i + compression.WINDOW] for i in range(0, len(raw), compression.WINDOW)]
        assert r.size == len(raw)
        assert r.good == sum(len(compression.compressor(good).compress(p)) for p in pieces)
        assert r.bad == sum(len(compression.compressor(bad).compress(p)) for p in pieces)


def test_odd_rows(spark, labelled, docs):
    _, labels = labelled
    odd = docs.select("*", *[F.lit("other").alias(c) for c in (*CLASHING, "quality", "good", "bad", "score", "held_out")])
    rows = compression.score_quality(odd, labels).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r, text in ((r, t) for r in rows for t in [None] if r.size == 0):
        by_text.setdefault(text, set()).add(r.score)
    assert len(by_text[None]) == 1  # null and empty texts alike
    assert all(not r.held_out for r in rows if r.doc_id is None)


@pytest.mark.parametrize("rows, score", [([], 0.5), ([(0, 1, 0)], None), ([(0, 1, 0), (0, 0, 0)], 0.5), ([(0, None, 0), (None, 1, 0)], 0.5), ([(10**9, 1, 0)], 0.5)])
def test_few_labels(spark, rows, score):
    docs = spark.createDataFrame([(k, "one two three") for k in range(4)], "doc_id long, text string")
    got = {r.score for r in compression.score_quality(docs, spark.createDataFrame(rows, LABELS)).collect()}
    assert len(got) == 1 and (score is None or got == {score})


def test_no_documents(spark, labelled):
    docs, labels = labelled
    assert compression.score_quality(docs.filter("false"), labels).count() == 0


def test_sample_is_bounded_and_does_not_depend_on_the_layout(labelled):
    docs, labels = labelled
    known = compression.one_label(labels)
    a, b = (
        sorted((r.quality, r.rank, bytes(r.window)) for r in compression.sample_windows(d, known, 50, 60).collect())
        for d in (docs, docs.repartition(7))
    )
    assert a == b and max(sum(q == v for q, _, _ in a) for v in (0, 1)) <= 60
