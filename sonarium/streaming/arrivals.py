"""Streams of results and of newly arriving files, written in restart-safe batches.

A micro-batch is written to its own folder ``batch_id=N`` with overwrite, so a batch that is run again after a failure
replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sonarium.operators.results import latest_results
from sonarium.sources.results import ResultLog


def read_drops(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files dropped into a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_result_stream(puts: DataFrame, log: str, checkpoint: str, keys: Sequence[str] = ("model", "key"), order: Sequence[str] = ("written_at", "seq")) -> StreamingQuery:
    """Append each batch's last write per key to the log; :func:`sonarium.operators.results.visible_results` reads it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_results(batch, keys, order).write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    return _start(puts, write, checkpoint)


def score_arrivals(
    files: DataFrame, key: str, event_time: str, delay: str, log: ResultLog, model: str, checkpoint: str, make_predict: Callable,
    features: Sequence[str], input_shapes: list | None = None,
) -> StreamingQuery:
    """Score files as they arrive, each key once within the watermark, unless the result log holds them; scores land in the log.

    A batch that is run again finds its scores in the log and adds nothing.
    """
    once = files.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        log.score(batch, key, model, make_predict, features, input_shapes)

    return _start(once, write, checkpoint)
