"""Custom datasets: one managed table of files, partitioned by session and dataset."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.operators.catalog import dedupe_filenames

COLUMNS = "original_filename STRING, filename STRING, duration DOUBLE, sample_rate INT, size BIGINT, uploaded_at TIMESTAMP, arrival BIGINT"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class DatasetTable:
    """Create, fill, read and delete datasets. Each dataset is a partition, so every read or delete is pruned to it."""

    def __init__(self, spark: SparkSession, table: str = "custom_datasets"):
        self.spark, self.table = spark, table
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({COLUMNS}, session_id STRING, dataset STRING) USING parquet "
            "PARTITIONED BY (session_id, dataset)"
        )

    def _partition(self, session_id: str, dataset: str | None = None) -> str:
        spec = f"session_id = {_text(session_id)}"
        return f"PARTITION ({spec}" + (f", dataset = {_text(dataset)})" if dataset is not None else ")")

    def exists(self, session_id: str, dataset: str) -> bool:
        return bool(self.spark.sql(f"SHOW PARTITIONS {self.table} {self._partition(session_id, dataset)}").take(1))

    def create(self, session_id: str, dataset: str) -> None:
        if self.exists(session_id, dataset):
            raise ValueError(f"dataset {dataset!r} already exists")
        self.spark.sql(f"ALTER TABLE {self.table} ADD {self._partition(session_id, dataset)}")

    def append(self, session_id: str, dataset: str, files: DataFrame) -> None:
        """Add files (``original_filename``, ``duration``, ``sample_rate``, ``size``, ``uploaded_at``, unique ``arrival``).

        A name the dataset already holds gets the first free suffix.
        """
        if not self.exists(session_id, dataset):
            raise ValueError(f"dataset {dataset!r} does not exist")
        held = self.read(session_id, dataset).select(F.col("filename").alias("original_filename"), "arrival")
        start = held.agg(F.struct((F.coalesce(F.max("arrival"), F.lit(-1)) + 1).alias("n")))
        fresh = files.withColumn("arrival", F.col("arrival") + start.scalar()["n"]).withColumn("_new", F.lit(True))
        both = held.withColumn("_new", F.lit(False)).unionByName(fresh, allowMissingColumns=True).withColumn("_d", F.lit(0))
        named = dedupe_filenames(both, ["_d"], "original_filename", "arrival").filter("_new")
        columns = [c.split()[0] for c in COLUMNS.split(", ")]
        named.select(*columns, F.lit(session_id).alias("session_id"), F.lit(dataset).alias("dataset")).write.mode(
            "append"
        ).insertInto(self.table)

    def read(self, session_id: str, dataset: str) -> DataFrame:
        return self.spark.table(self.table).filter((F.col("session_id") == session_id) & (F.col("dataset") == dataset))

    def delete(self, session_id: str, dataset: str) -> bool:
        """False if there was no such dataset."""
        if not self.exists(session_id, dataset):
            return False
        self.spark.sql(f"ALTER TABLE {self.table} DROP {self._partition(session_id, dataset)}")
        return True

    def delete_session(self, session_id: str) -> int:
        """Remove all datasets of a session; returns how many there were."""
        shown = self.spark.sql(f"SHOW PARTITIONS {self.table} {self._partition(session_id)}").collect()
        names = [unquote(r[0].split("/dataset=", 1)[1]) for r in shown]  # catalog entries, one per dataset
        if names:
            specs = ", ".join(self._partition(session_id, name) for name in names)
            self.spark.sql(f"ALTER TABLE {self.table} DROP {specs}")
        return len(names)
