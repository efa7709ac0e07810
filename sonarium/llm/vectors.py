"""Numeric vectors of a table as flat matrices, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound_vectors(df: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector is present, holds finite entries only and has the table's usual length, and that length.

    The usual length is the most frequent one among the other rows (of equally frequent ones the longest), empty vectors aside; it is 0 if
    there is no such row.
    """
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = df.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(finite)
    lengths = sound.groupBy(F.size(column).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.col("n").desc(), F.col("width").desc()).first()
    width = usual["width"] if usual else 0
    return sound.filter(F.size(column) == width), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The entries of a batch's vectors as doubles, one row each."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), width)


def scaled_floor(values: np.ndarray, factor: int, most: int) -> np.ndarray:
    """``floor(factor * x)`` as integers; ``factor`` is a power of two, so the product is exact. Beyond ``most`` in size it is an error."""
    whole = np.floor(values * factor)
    if whole.size and np.abs(whole).max() > most:
        raise ValueError(f"vector entries beyond {most / factor:g} in size are not supported")
    return whole.astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``rows`` rows; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            table = pa.Table.from_batches(held)
            while len(table) >= rows:
                yield table.slice(0, rows).combine_chunks()
                table = table.slice(rows)
            held, count = table.to_batches(), len(table)
    if count:
        yield pa.Table.from_batches(held).combine_chunks()
