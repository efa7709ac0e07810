"""Dataset metadata files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def read_metadata(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with a header: names trimmed and lower-cased, values trimmed of all white space, every column a string.

    Quoted line breaks keep a file in one split; turn ``multi_line`` off for large files that have none.
    """
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return named.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(SPACE)).alias(c) for c in named.columns])
