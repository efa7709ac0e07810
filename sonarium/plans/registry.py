"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is the same result in SQL, left out where SQL cannot say it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a file with fewer splits than cores out to all cores; larger inputs are left as they are.

    Only for scans that feed costly row-local work: at scale there are always enough splits and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Rounding used by registered queries so that both engines print the same double."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def sql_rnd(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL; a negative zero becomes zero."""
    value = f"round(CAST({expr} AS DOUBLE), {digits})"
    return f"(CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END)"
