"""Product-quantised vector codes with exact integer codebooks, over Hilbert-sorted flat blocks.

Vectors become integers and are cut into parts. A task lays its vectors out in chunks; in a chunk each part is sorted along a Hilbert
curve and cut into blocks that know the corners of the box around them and the sum of their members. A round compares boxes with
codebook entries first: an entry that is farther from every point of a box than another one can win nowhere in it. A block with a single
entry left gives its stored sum; the others run a small exact kernel on the entries of their shortlist.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.common import attach, written
from sonarium.llm.vectors import chunks, matrix, scaled_floor, sound_vectors

PARTS = 4
ENTRIES = 256
ROUNDS = 4
FACTOR = 1024
#: Largest integer component; squared distances and their sums then fit 64 bits.
MOST = 1 << 28
#: Vectors of one flat block row, about 2 MB of them at 64 entries.
CHUNK = 8192
BLOCK = 64
EXACT_IN_DOUBLE = 1 << 53



def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (coordinates of ``bits`` bits) on the Hilbert curve through their cube.

    Skilling's transform turns coordinates into the transposed index; its bits are then dealt into one number of 63 bits at most.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    for power in range(bits - 1, 0, -1):
        bit, mask = 1 << power, (1 << power) - 1
        for i in range(n):
            inside = (x[:, i] & bit) != 0
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, i]) & mask)
            x[:, 0] ^= np.where(inside, mask, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for power in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, n - 1] & (1 << power), (1 << power) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for power in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[:, i] >> power & 1
    return key


def curve_order(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Order of the rows along a Hilbert curve through the box ``low`` to ``high``; what lies outside is moved to its wall.

    The order decides only how tight boxes get, never a result.
    """
    dims = min(values.shape[1], 63)
    bits = max(1, 63 // dims)
    bits = min(bits, 8)
    span = np.maximum(high - low, 1)[:dims]
    cells = (np.clip(values[:, :dims], low[:dims], high[:dims]) - low[:dims]) * ((1 << bits) - 1) // span
    return np.argsort(hilbert_keys(cells, bits), kind="stable")


def cut_blocks(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest corner and componentwise sum of each run of ``block`` rows."""
    at = np.arange(0, len(values), block)
    return np.minimum.reduceat(values, at), np.maximum.reduceat(values, at), np.add.reduceat(values, at)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Per block (rows) which entries (columns) can be nearest to some point of its box.

    An entry stays if its least distance to the box is at most the smallest of all entries' greatest distances to it. Ties stay, so
    the lower index can still win them.
    """
    under, over = low[:, None, :] - entries[None], entries[None] - high[:, None, :]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and its squared distance, exactly.

    As long as every intermediate integer is below 2**53 the products run as doubles, which hold such integers exactly.
    """
    bound = max(int(np.abs(values).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * values.shape[1] * bound * bound < EXACT_IN_DOUBLE else np.int64
    v, e = values.astype(kind), entries.astype(kind)
    apart = (v * v).sum(axis=1)[:, None] - 2 * (v @ e.T) + (e * e).sum(axis=1)[None]
    found = apart.argmin(axis=1)
    return found, apart[np.arange(len(v)), found].astype(np.int64)


def assign(flat: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray, entries: np.ndarray, block: int = BLOCK):
    """For each block ``(first row, end, indexes, distances)``; a block that one entry wins whole has that index and None instead."""
    step = max(1, (1 << 20) // max(1, entries.size))
    for first in range(0, len(low), step):
        open_ = shortlists(low[first : first + step], high[first : first + step], entries)
        for k, row in enumerate(open_, first):
            a, b = k * block, min((k + 1) * block, len(flat))
            few = np.flatnonzero(row)
            if len(few) == 1:
                yield k, a, b, few[0], None
            else:
                index, distance = nearest(flat[a:b], entries[few])
                yield k, a, b, few[index], distance


def _ints(raw: bytes, width: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, width).astype(np.int64)


def flat_blocks(vectors: DataFrame, width: int, parts: int, low: np.ndarray, high: np.ndarray, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """One row per chunk of ``vectors (vec_id, label_key, embedding)``: ids, labels, and for each part its flat blocks.

    ``order`` holds the rows' order along the curve, ``flat`` the components in that order, ``low``, ``high`` and ``total`` the blocks' boxes
    and sums; each is an array with one entry per part. No row leaves its task.
    """

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = width // parts
        for table in chunks(batches, chunk):
            whole = scaled_floor(matrix(table["embedding"].chunk(0), width), FACTOR, MOST)
            cols: dict[str, list[bytes]] = {c: [] for c in ("order", "flat", "low", "high", "total")}
            for p in range(parts):
                mine = whole[:, p * wide : (p + 1) * wide]
                order = curve_order(mine, low[p], high[p])
                mine = mine[order]
                a, b, t = cut_blocks(mine, block)
                cols["order"].append(order.astype(np.int32).tobytes())
                cols["flat"].append(mine.astype(np.int32).tobytes())
                cols["low"].append(a.tobytes())
                cols["high"].append(b.tobytes())
                cols["total"].append(t.tobytes())
            ids = pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64()))
            labels = pa.array([table["label_key"].to_pylist()], pa.list_(pa.string()))
            arrays = [pa.array([v], pa.list_(pa.binary())) for v in cols.values()]
            yield pa.RecordBatch.from_arrays([ids, labels, *arrays], ["vec_id", "label_key", *cols])

    binaries = ", ".join(f"{c} array<binary>" for c in ("order", "flat", "low", "high", "total"))
    return vectors.mapInArrow(lay_out, f"vec_id array<long>, label_key array<string>, {binaries}")


def _parts(row: dict, p: int, wide: int) -> tuple[np.ndarray, ...]:
    return _ints(row["flat"][p], wide, np.int32), _ints(row["low"][p], wide), _ints(row["high"][p], wide), _ints(row["total"][p], wide)


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(len(batch)):
        yield batch.slice(k, 1).to_pylist()[0]


def round_sums(store: DataFrame, codebook: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``part, entry, n, total``: how many parts each entry wins, and their componentwise sums. One row per entry and task is shuffled."""
    parts, entries, wide = codebook.shape

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in batches:
            for row in _one_by_one(batch):
                for p in range(parts):
                    flat, low, high, sums = _parts(row, p, wide)
                    for k, a, b, index, distance in assign(flat, low, high, sums, codebook[p], block):
                        if distance is None:
                            n[p, index] += b - a
                            total[p, index] += sums[k]
                        else:
                            n[p] += np.bincount(index, minlength=entries)
                            np.add.at(total[p], index, flat[a:b])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "total"],
        )

    each = store.select("flat", "low", "high", "total").mapInArrow(tally, "part int, entry int, n long, total array<long>")
    sums = F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(wide)])
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("total"))


def next_codebook(codebook: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Entries become the floors of their parts' means; unused ones stay. At most one row per entry reaches the driver."""
    out = codebook.copy()
    for row in sums.collect():
        out[row["part"], row["entry"]] = np.array(row["total"], np.int64) // row["n"]
    return out


def coded(store: DataFrame, codebook: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``vec_id, label_key, code, error``: the final assignment of every vector."""
    parts, _, wide = codebook.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                rows = len(row["vec_id"])
                codes, error = np.zeros((rows, parts), np.uint8), np.zeros(rows, np.int64)
                for p in range(parts):
                    flat, low, high, sums = _parts(row, p, wide)
                    order = np.frombuffer(row["order"][p], np.int32)
                    for _, a, b, index, distance in assign(flat, low, high, sums, codebook[p], block):
                        if distance is None:
                            distance = ((flat[a:b] - codebook[p, index]) ** 2).sum(axis=1)
                        codes[order[a:b], p] = index
                        error[order[a:b]] += distance
                digits = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["vec_id"], pa.int64()), pa.array(row["label_key"], pa.string()),
                        pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]), pa.array(error),
                    ],
                    ["vec_id", "label_key", "code", "error"],
                )

    return store.mapInArrow(encode, "vec_id long, label_key string, code string, error long")


def codebook_digest(codebook: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebook.ravel().tolist())).encode()).hexdigest()


def compress_vectors(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per sound row of ``df (vec_id, embedding, label)``: ``vec_id, code, error, label_error, codebooks_sha256``.

    Dropped are null and empty vectors, vectors with null or non-finite entries, and those that have not the table's usual length
    (:func:`sonarium.llm.vectors.sound_vectors`), which must be a multiple of ``parts``. The first codebook comes from the smallest ids, null
    ids last, equal ids in the order of their vectors; fewer rows than ``entries`` give fewer entries. Repeated rows count each time.
    Null labels are one label. Entries beyond 2**18 in size are an error. An empty table gives no rows; extra columns are ignored.
    """
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    plain = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label_key"), "embedding")
    vectors, width = sound_vectors(plain)
    if width % parts:
        raise ValueError(f"vectors of length {width} cannot be cut into {parts} equal parts")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    wide = width // parts
    start = scaled_floor(np.array([r[0] for r in first], np.float64).reshape(len(first), width), FACTOR, MOST)
    codebook = np.ascontiguousarray(start.reshape(len(first), parts, wide).transpose(1, 0, 2))
    low, high = (codebook.min(axis=1), codebook.max(axis=1)) if len(first) else (codebook, codebook)
    store = written(flat_blocks(vectors, width, parts, low, high), "flat-blocks")
    if len(first):
        for _ in range(rounds):
            codebook = next_codebook(codebook, round_sums(store, codebook))
    rows = written(coded(store, codebook), "vector-codes")
    by_label = rows.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    full = attach(rows, written(by_label, "label-errors"), ["label_key"])
    return full.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebook)).alias("codebooks_sha256"))
