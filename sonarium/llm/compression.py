"""Quality by compression: dictionaries of good and of bad text, and the calibrated difference of the sizes they give.

Windows of labelled texts become two Zstandard dictionaries. Every text is then compressed twice, window by window, and the
difference of both sizes per byte says which of the two it resembles. A logistic curve, fitted on labelled texts that no dictionary
has seen, turns the difference into a probability.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.common import written
from sonarium.llm.words import text_buffers

#: Labelled documents of each label whose windows may enter a dictionary, and windows that do (the bound of the training sample).
SAMPLE_DOCS = 4000
SAMPLE_WINDOWS = 4000
WINDOW = 1024
DICTIONARY_BYTES = 224 << 10
LEVEL = 3
#: Bytes added to a text's length, so that the few bytes of a short text decide little.
CUSHION = 16
KEEP = 0.7
BATCH = "doc_id long, size long, good long, bad long"


def fold(doc_id: Column) -> Column:
    """Remainder of the CRC-32 of the id's digits by 4: 2 is held out, 0 and 1 feed the dictionaries, 3 the calibration. A null id has none."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def windows(raw: np.ndarray, width: int) -> list[bytes]:
    """All bytes of a text, cut into pieces of ``width`` (the last may be shorter)."""
    whole = raw.tobytes()
    return [whole[i : i + width] for i in range(0, len(whole), width)]


def one_label(labels: DataFrame) -> DataFrame:
    """``doc_id, quality``: one row per labelled id; ids without label, or with both labels, are left out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    both = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_high"))
    return both.filter(F.col("quality") == F.col("_high")).select("doc_id", F.col("quality").cast("int").alias("quality"))


def sample_windows(docs: DataFrame, labels: DataFrame, most_docs: int = SAMPLE_DOCS, most: int = SAMPLE_WINDOWS, width: int = WINDOW) -> DataFrame:
    """``quality, rank, window``: at most ``most`` windows of each label, from at most ``most_docs`` of its documents.

    Documents and windows are those with the smallest hashes, so the sample does not depend on how the rows lie. Windows come from
    anywhere in a text. Only narrow rows are shuffled: the ids to choose from, and the windows that lead in their task.
    """
    mine = labels.filter(fold(F.col("doc_id")) < 2).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    mine = written(mine.withColumn("_h", F.xxhash64("doc_id")), "labelled")
    chosen = [mine.filter(F.col("quality") == v).orderBy("_h", "doc_id").limit(most_docs) for v in (0, 1)]
    chosen = written(chosen[0].unionByName(chosen[1]).drop("_h"), "chosen")  # 2 * most_docs rows at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
        for batch in batches:
            raw, at = text_buffers(batch.column("text"))
            for k, (i, q) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), strict=True)):
                for w, piece in enumerate(windows(raw[at[k] : at[k + 1]], width)):
                    rank = int.from_bytes(hashlib.blake2b(b"%d %d" % (i, w), digest_size=7).digest())
                    (heapq.heappush if len(best[q]) < most else heapq.heappushpop)(best[q], (-rank, piece))
        rows = [(q, -rank, piece) for q in best for rank, piece in best[q]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
            ["quality", "rank", "window"],
        )

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    led = written(texts.mapInArrow(cut, "quality int, rank long, window binary"), "windows")
    halves = [led.filter(F.col("quality") == v).orderBy("rank", "window").limit(most) for v in (0, 1)]
    return halves[0].unionByName(halves[1])


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES, level: int = LEVEL) -> bytes:
    """A trained dictionary; samples too few or too small to train on become a dictionary of their raw content."""
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    """Frames without length, checksum and dictionary id, which would be the same bytes for both dictionaries."""
    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:  # nothing was labelled so
        return zstandard.ZstdCompressor(level=level, **bare)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, **bare)


def compressed_sizes(docs: DataFrame, good: bytes, bad: bytes, width: int = WINDOW, level: int = LEVEL) -> DataFrame:
    """``doc_id, size, good, bad``: per row the UTF-8 bytes of its whole text, and those left of them with either dictionary."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [compressor(good, level), compressor(bad, level)]
        for batch in batches:
            raw, at = text_buffers(batch.column("text"))
            sizes = np.zeros((2, len(batch)), np.int64)
            for k in range(len(batch)):
                for piece in windows(raw[at[k] : at[k + 1]], width):
                    sizes[0, k] += len(by[0].compress(piece))
                    sizes[1, k] += len(by[1].compress(piece))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.array(sizes[0]), pa.array(sizes[1])],
                ["doc_id", "size", "good", "bad"],
            )

    return docs.select("doc_id", "text").mapInArrow(measure, BATCH)


def difference() -> Column:
    """Bytes that the good dictionary saves over the bad one, per byte of text; 0 for an empty text."""
    return (F.col("bad") - F.col("good")) / (F.col("size") + F.lit(CUSHION))


def calibrate(measured: DataFrame) -> Column:
    """Probability of label 1 as a logistic function of :func:`difference`, fitted on ``measured (size, good, bad, quality)``.

    With one label only the probability is that label's smoothed share, and without labels 0.5.
    """
    counts = {r["quality"]: r["n"] for r in measured.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return F.lit((counts.get(1, 0) + 1.0) / (sum(counts.values()) + 2.0))
    rows = measured.select(difference().alias("x"), F.col("quality").cast("double").alias("y"))
    rows = VectorAssembler(inputCols=["x"], outputCol="v").transform(rows).select("v", "y")
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=1e-5, maxIter=100).fit(rows)
    return 1.0 / (1.0 + F.exp(-(F.lit(float(model.coefficients[0])) * difference() + F.lit(float(model.intercept)))))


def score_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, held_out, score, predicted``, and the sizes the score comes from.

    ``labels (doc_id, quality)`` teaches only through rows whose :func:`fold` is not 2. Only the text enters a score, so equal texts have equal
    scores, however often they repeat. A null text is an empty one: its difference is 0. A null id is scored like any other and not held
    out. Labels that are null, contradict each other or belong to no document teach nothing; with none at all every score is 0.5. Very
    long texts are measured whole, window by window, in memory of the order of the batch. An empty table gives no rows; extra columns
    are ignored.
    """
    docs, known = docs.select("doc_id", "text"), written(one_label(labels), "quality-labels")
    sample = sample_windows(docs, known).collect()  # bounded by SAMPLE_WINDOWS pieces of WINDOW bytes for each label
    good, bad = (build_dictionary([bytes(r["window"]) for r in sample if r["quality"] == v]) for v in (1, 0))
    sizes = written(compressed_sizes(docs, good, bad), "compressed-sizes")
    unseen = known.filter(fold(F.col("doc_id")) == 3)
    fit = written(sizes.join(unseen, "doc_id").select("size", "good", "bad", "quality"), "calibration")
    if fit.select("quality").distinct().count() < 2:
        # too few labels to keep some from the dictionaries
        fit = sizes.join(known.filter(fold(F.col("doc_id")) != 2), "doc_id").select("size", "good", "bad", "quality")
    score = calibrate(fit)
    return sizes.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        score.cast("double").alias("score"),
        (score >= keep).cast("int").alias("predicted"),
        "size",
        F.col("good").alias("good_bytes"),
        F.col("bad").alias("bad_bytes"),
    )
