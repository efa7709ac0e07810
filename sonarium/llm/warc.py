"""WARC archives compressed with Zstandard: one frame per record and the dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.common import written

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 4 << 20
SAMPLE_RECORDS = 256
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: control characters become percent escapes."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, first: int | None, is_first: bool, date: str) -> bytes:
    """A response record, or a revisit record that refers to the response with the same payload and leaves the body out."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if is_first else http
    head = [
        ("WARC-Type", "response" if is_first else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if not is_first:
        head[3:3] = [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", SAME_PAYLOAD)]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Collects records; the first ones train the archive's dictionary, where they are enough for one."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []
        self.parts: list[bytes] = []
        self.size = self.held = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        if self.compressor:
            self._put(record)
            return
        self.waiting.append(record)
        self.held += len(record)
        if len(self.waiting) >= SAMPLE_RECORDS or self.held >= SAMPLE_BYTES:
            self._start()

    def _put(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.parts.append(frame)
        self.size += len(frame)

    def _start(self) -> None:
        settings = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=True, write_checksum=True, write_dict_id=True)
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in self.waiting])
        except zstandard.ZstdError:  # too few or too equal samples: the archive does without
            trained = None
        if trained:
            packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
            self.parts.append(SKIPPABLE.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
            self.size += len(self.parts[0])
        self.compressor = zstandard.ZstdCompressor(compression_params=settings, dict_data=trained) if trained else (
            zstandard.ZstdCompressor(compression_params=settings)
        )
        for record in self.waiting:
            self._put(record)
        self.waiting = []

    def archive(self) -> bytes:
        if self.waiting:
            self._start()
        return b"".join(self.parts)


def _write(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, number, writer = context.partitionId() if context else 0, 0, ArchiveWriter()

        def close() -> pa.RecordBatch:
            name = f"part-{part:05d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.archive()], pa.binary())], ["path", "content"])

        for batch in batches:
            for row in zip(*[batch[c] for c in ("page_id", "url", "html", "first", "is_first")], strict=True):
                page_id, url, html, first, is_first = (x.as_py() for x in row)
                writer.add(record_bytes(page_id, url, (html or "").encode(), first, is_first, date))
                if writer.size >= ARCHIVE_BYTES:
                    yield close()
                    number, writer = number + 1, ArchiveWriter()
        if writer.size or writer.waiting:
            yield close()

    return run


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``path, content``: archives of about 4 MB with one record per row of ``pages (page_id, url, html)``.

    Of the pages with equal payloads of at least ``least_bytes``, those with the smallest ``page_id`` are responses and the others
    revisit it. Equal payloads are found by SHA-256 and length. Only digests that occur twice are joined back to the pages, on
    narrow rows; the widely repeated ones by a broadcast of at most a thousand rows .

    Null html: an empty payload; null url: an empty target. A page without id comes last; pages without any id are all
    responses. Rows that repeat the smallest id are all responses. Extra columns are ignored; no pages give no archives.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("digest"))
    # texts below the limit, and later the widely shared ones, get a key of their own: it matches nothing and spreads
    alone = F.unhex(F.sha2(F.concat_ws("-", F.lit("alone"), "page_id", "url"), 256))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.col("digest")).otherwise(alone))
    ids = written(rows.select("page_id", "digest"), "page-digests")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_rows"))
    shared = written(firsts.filter(F.col("_rows") > 1), "shared-digests")
    limit = ids.count() // 1000
    hot = shared.filter(F.col("_rows") > limit).select("digest", F.col("first").alias("hot_first"))
    cold = shared.filter(F.col("_rows") <= limit).select("digest", F.col("first").alias("cold_first"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    rows = rows.withColumn("digest", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(alone))
    joined = rows.join(cold, "digest", "left")
    first = F.coalesce("hot_first", "cold_first")
    out = joined.select(
        "page_id", "url", "html", first.alias("first"),
        (first.isNull() | F.coalesce(F.col("page_id") == first, F.lit(False))).alias("is_first"),
    )
    return out.mapInArrow(_write(date), "path string, content binary")


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame that begins at ``at``, from its header and block headers."""
    if bytes(data[at : at + 4]) != FRAME:
        raise ValueError("no frame begins here")
    flags = data[at + 4]
    alone, content = flags >> 5 & 1, flags >> 6
    end = at + 5 + (1 - alone) + (0, 1, 2, 4)[flags & 3] + ((1 if alone else 0), 2, 4, 8)[content]
    while True:
        if end + 3 > len(data):
            raise ValueError("frame cut short")
        block = int.from_bytes(data[end : end + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError("reserved block type")
        end += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ValueError("frame cut short")
    return end - at


def load_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, which may itself be compressed, and where the records begin."""
    if int.from_bytes(data[:4], "little") != SKIPPABLE:
        return None, 0
    size = int.from_bytes(data[4:8], "little")
    body = bytes(data[8 : 8 + size])
    if len(body) != size:
        raise ValueError("dictionary cut short")
    if body[:4] == FRAME:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if body[:4] != DICTIONARY:
        raise ValueError("no dictionary in the leading frame")
    return zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT), 8 + size


def parse_record(raw: bytes) -> dict:
    """Headers and block of the one record in ``raw``, checked: version, needed headers, lengths and digests."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[name.strip().lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"missing {', '.join(sorted(missing))}")
    if not headers["content-length"].isdigit():
        raise ValueError("content-length is no number")
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("length differs from content-length")
    if (told := headers.get("warc-block-digest")) and told != f"sha1:{payload_digest(block)}":
        raise ValueError("block digest differs")
    return headers | {"block": block}


def parse_http(block: bytes) -> tuple[int, bytes]:
    """Stated payload length and the payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    if not gap or not head.startswith(b"HTTP/") or not found:
        raise ValueError("no HTTP header")
    return int(found[1]), payload


def _facts(headers: dict) -> tuple:
    kind, payload_bytes, payload = headers["warc-type"], None, None
    if kind in ("response", "revisit"):
        payload_bytes, payload = parse_http(headers["block"])
        if kind == "response" and len(payload) != payload_bytes:
            raise ValueError("payload differs from its length")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response" and digest and digest != payload_digest(payload):
        raise ValueError("payload digest differs")
    return (
        kind, headers["warc-record-id"], headers["warc-date"], headers.get("warc-target-uri"), headers.get("warc-refers-to"),
        payload_bytes, digest, payload if kind == "response" else None,
    )


RECORD = {
    "record_type": pa.string(), "record_id": pa.string(), "date": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
}


def read_records(data: memoryview) -> Iterator[tuple]:
    """``offset, error, facts`` of each record. Behind a damaged frame the next frame's start is sought."""
    try:
        dictionary, at = load_dictionary(data)
        reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    except (ValueError, zstandard.ZstdError) as e:
        yield 0, str(e), (None,) * len(RECORD)
        return
    while at < len(data):
        try:
            size = frame_length(data, at)
        except ValueError as e:
            yield at, str(e), (None,) * len(RECORD)
            ahead = bytes(data[at + 4 :]).find(FRAME)
            if ahead < 0:
                return
            at += 4 + ahead
            continue
        try:
            yield at, None, _facts(parse_record(reader.decompress(data[at : at + size])))
        except (ValueError, zstandard.ZstdError) as e:
            yield at, str(e), (None,) * len(RECORD)
        at += size


def _read(payloads: bool):
    names = [n for n in RECORD if payloads or n != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                buffer = content.as_buffer()
                for offset, error, facts in read_records(memoryview(buffer) if buffer is not None else memoryview(b"")):
                    rows.append((path.as_py(), offset, error, *facts[: len(names)]))
                    size += len(facts[-1] or b"") if payloads else 0
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), *[RECORD[n] for n in names]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "offset", "error", *names]
    )


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of ``files (path, content)``, such as ``spark.read.format("binaryFile")`` gives.

    The dictionary comes from the leading skippable frame; each further frame must hold one whole record. A record that is cut
    short, does not decode, lacks headers, or whose lengths or digests differ keeps its ``offset`` and an ``error``.
    """
    kinds = {"payload_bytes": "long", "payload": "binary"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in RECORD if payloads or n != "payload")
    return files.select("path", "content").mapInArrow(_read(payloads), f"path string, offset long, error string, {schema}")


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in a table in the shared folder and read them back: one row per page."""
    stored = written(write_archives(pages), "archives")
    read = read_archives(stored, payloads=False)
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("record_type"))
    return read.select(
        _page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"),
        _page(F.col("refers_to")).alias("refers_to"), F.col("target_uri").alias("url"),
    )
