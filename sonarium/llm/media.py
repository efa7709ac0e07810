"""Media columns: texts stored as baseline JPEG, read back and described by DC-only thumbnails."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.common import written
from sonarium.llm.jpeg import decode, encode, stored_bytes, thumbnail_hashes

SLICE = 1 << 21
BLOCK = 64


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    a = total = 0
    for k, size in enumerate(sizes):
        if k > a and total + size > most:
            yield a, k
            a, total = k, 0
        total += size
    if sizes:
        yield a, len(sizes)


def _padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.binary_length(batch["text"]).fill_null(0).to_pylist()
        for a, b in _runs(sizes, SLICE):
            pairs = [_padded(t.as_py()) for t in batch["text"][a:b]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"][a:b], pa.array([n for n, _ in pairs], pa.int64()), pa.array(list(encode(p for _, p in pairs)), pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a JPEG.

    JPEG's own unit is the quantised coefficient, so each 64 bytes become one 8 x 8 block's coefficients, which entropy coding
    keeps exactly. Null text counts as empty (one block of zeros); repeated rows give equal files; extra columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_DESCRIBED = (
    "width int, height int, thumb_width int, thumb_height int, mean_hash string, gradient_hash string, thumb_sha1 string, "
    "media_bytes long, media_sha256 string, error string"
)
_PAYLOAD = "payload_bytes long, payload_sha256 string, tail_crc32 long"


def _read(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "media"]
            sizes = pc.binary_length(batch["media"]).fill_null(0).to_pylist()
            for a, b in _runs(sizes, SLICE):
                media = [m.as_py() or b"" for m in batch["media"][a:b]]
                rows = []
                for data, pic in zip(media, decode(media), strict=True):
                    facts: list = [None] * 7
                    kept: list = [None] * 3
                    if not pic.error:
                        facts = [pic.width, pic.height, -(-pic.width // 8), -(-pic.height // 8), *thumbnail_hashes(pic)]
                        if payload:
                            back = stored_bytes(pic)
                            kept = [len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:])]
                    rows.append((*facts, len(data), hashlib.sha256(data).hexdigest(), pic.error or None, *(kept if payload else ())))
                kinds = [pa.int32()] * 4 + [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string()]
                kinds += [pa.int64(), pa.string(), pa.int64()] if payload else []
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [x.split(" ")[0] for x in (_DESCRIBED + (f", {_PAYLOAD}" if payload else "")).split(", ")]
                yield pa.RecordBatch.from_arrays([*[batch[c][a:b] for c in rest], *columns], [*rest, *names])

    return run


def describe_media(media: DataFrame, payload: bool = False) -> DataFrame:
    """Replace the column ``media`` (JPEG files) by dimensions, thumbnail size and hashes, the file's length and SHA-256.

    Markers are parsed and scans Huffman-decoded; the thumbnail takes each block's DC coefficient of the first component. A file
    that is null, cut short, damaged or not baseline gets an ``error`` and nulls. With ``payload``, bytes stored by
    :func:`store_texts` are restored and hashed. No other column may have one of the new names.
    """
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")
    return media.mapInArrow(_read(payload), ", ".join([*([rest] if rest else []), _DESCRIBED, *([_PAYLOAD] if payload else [])]))


def text_media(docs: DataFrame) -> DataFrame:
    """Store all texts as JPEG in a table in the shared folder, read it back and describe it; one row per document."""
    stored = written(store_texts(docs), "media")
    read = describe_media(stored, payload=True)
    feature = F.concat_ws(":", F.concat_ws("x", "width", "height"), "mean_hash", "gradient_hash", "thumb_sha1")
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        feature.alias("feature"), "width", "height", "thumb_width", "thumb_height",
    )
