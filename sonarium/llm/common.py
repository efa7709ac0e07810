"""Helpers shared by the operators of this package: settled tables, hot keys, running sums and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonarium.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the cluster's shared checkpoint folder and read it back.

    It is computed once, later passes read only the columns they need, and a lost executor loses none of it.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often and however deep ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column, run: int = 128) -> Column:
    """Sum of the earlier elements for each element of an array, by sums of whole runs of elements and of the rest of one run."""

    def add(of: Column, low: Column, n: Column) -> Column:
        return F.aggregate(F.slice(of, low + 1, n), F.lit(0).cast("long"), lambda s, x: s + x)

    def over(each: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), F.floor(F.size(each) / run).cast("int")), lambda r: add(each, r * run, F.lit(run)))
        before = let(totals, lambda t: F.transform(t, lambda _, r: add(t, F.lit(0), r)))
        return let(before, lambda b: F.transform(each, lambda _, i: F.get(b, F.floor(i / run).cast("int")) + add(each, i - i % run, i % run)))

    return let(values, over)


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], share: int = 1000) -> DataFrame:
    """Left-join one row per key; ``side`` has a column ``_rows``, the number of rows of ``df`` with that key.

    Keys that hold more than one ``share``-th of all rows are fewer than ``share``, so their part of ``side`` is broadcast;
    the rest meets in a shuffle in which no key has more than that fraction of the rows. Both inputs are settled tables.
    """
    values = [c for c in side.columns if c not in (*keys, "_rows")]
    limit = df.count() // share
    hot = side.filter(F.col("_rows") > limit).select(*keys, F.struct(*values).alias("_hot"))
    cold = side.filter(F.col("_rows") <= limit).drop("_rows")
    held = df.join(F.broadcast(hot), list(keys), "left")
    first = held.filter(F.col("_hot").isNotNull()).select(*df.columns, *[F.col(f"_hot.{v}").alias(v) for v in values])
    rest = held.filter(F.col("_hot").isNull()).drop("_hot").join(cold, list(keys), "left")
    return first.unionByName(rest.select(*df.columns, *values))


def bucket_bits(rows: int, per_bucket: int = 4096, most: int = 16) -> int:
    """Bits of a hash that cut ``rows`` rows into buckets of about ``per_bucket``, at most ``2**most`` buckets."""
    return min(most, max(0, (max(rows, 1) // per_bucket).bit_length()))


def running(
    df: DataFrame, group: str, hashed: str, ties: Sequence[str], weight: Column, out: str, bits: int
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the group, in the order of ``hashed`` (a uniform 64-bit hash), then ``ties``.

    A group is cut by the leading bits of the hash into ``2**bits`` buckets. Buckets are summed before the shuffle, only
    their sums pass a window over the group, and rows meet the rows of their own bucket only, so a group with most of the
    rows is ordered by many tasks. ``group`` must not be null. The result has one row per input row.
    """
    place = F.shiftrightunsigned(hashed, 64 - bits).cast("int") if bits else F.lit(0)
    rows = df.withColumn("_bucket", place).withColumn("_weight", weight)
    sums = rows.groupBy(group, "_bucket").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy(group, "_bucket").orderBy(hashed, *ties).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(starts, [group, "_bucket"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .drop("_bucket", "_weight", "_start")
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links (a, b)``: the label is the smallest node that can be reached.

    Alternates the large-star and small-star steps: every step replaces links by links to a smaller neighbour, and each
    neighbourhood is reduced to its minimum before the shuffle. Only two totals reach the driver to see when nothing moves.
    """
    edges = written(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    seen = None
    while True:
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == seen or not total[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label"))
            ).distinct()
        seen = total
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(lowest, "u").filter(F.col("v") > F.col("u")).filter(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .filter(F.col("u") != F.col("v"))
        )
        edges = written(small.distinct(), "small-star")
