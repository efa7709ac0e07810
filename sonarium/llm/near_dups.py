"""Near copies by MinHash with tensored banding, verified on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonarium.llm.common import attach, components, written
from sonarium.llm.words import WordHasher, mix, shingle_sets, slices

SLICE = 4 << 20
ROOT_WIDTH = 2
NO_ID = (1 << 63) - 1


def root_tables(percent: int, miss: float = 1e-6, width: int = ROOT_WIDTH) -> int:
    """Keys per collection so that a pair at the threshold shares no table with a probability of ``miss`` at most."""
    agree = (percent / 100) ** width
    return 1 if agree >= 1 else math.ceil(math.log(miss / 2) / math.log1p(-agree))


def minhash_keys(sets: list[np.ndarray], tables: int, width: int = ROOT_WIDTH) -> np.ndarray:
    """Per set two collections of ``tables`` keys, each key made of ``width`` minima."""
    rng = np.random.Generator(np.random.PCG64(7))
    n = 2 * tables * width
    times = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), 2 * tables), np.uint64)
    for k in range(2 * tables):
        key = np.full(len(sets), k + 1, np.uint64)
        for j in range(k * width, (k + 1) * width):
            key = mix(key * np.uint64(3) + np.minimum.reduceat((values ^ flip[j]) * times[j], starts))
        keys[:, k] = key
    return keys


def _describe(width: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b in slices(batch["text"], SLICE):
                part = batch.slice(a, b - a)
                sets = list(shingle_sets(part["text"], width, hasher))
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, minhash_keys([sets[k] for k in full], tables).view(np.int64), strict=True):
                        keys[k] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["text_hash"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "n", "set_id", "keys"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for a, b in slices(batch["text"], SLICE):
                part = batch.slice(a, b - a)
                sets = [s.view(np.int64) for s in shingle_sets(part["text"], width, hasher)]
                ends = np.cumsum([0, *map(len, sets)])
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part["node"], values], ["node", "shingles"])

    return run


def _node(doc_id: Column, text_hash: Column) -> Column:
    return F.struct(F.coalesce(doc_id, F.lit(NO_ID)).alias("d"), text_hash.alias("h"))


NODE = T.StructType([T.StructField("d", T.LongType(), False), T.StructField("h", T.LongType(), False)])


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def verify(pairs: DataFrame, bodies: DataFrame, percent: int, per_part: int = 4096) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets overlap enough. ``b`` may be the centre of very many pairs.

    A centre's set is repeated once per ``per_part`` of its pairs, so its pairs are compared by several tasks.
    """
    load = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts"))
    centres = bodies.join(load, bodies["node"] == load["b"]).select(
        "b", F.col("shingles").alias("set_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    dealt = pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"))
    sides = dealt.join(centres, ["b", "part"]).join(
        bodies.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a"
    )
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (
        sides.select("a", "b", shared.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
        .filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


def _rest(members: DataFrame, labels: DataFrame, bodies: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """Pairs that the centres left open: in a common table, in different components, never compared.

    Two sets that overlap enough share one of the rarest shingles of each (its prefix in the order of frequency), and behind the
    first one they share, enough of both sets is left. Only pairs that meet both conditions are listed; no link is left out.
    """
    held = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = written(held.select("key", "node", "label", "n"), "labelled-members")
    mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    still = held.join(mixed.filter(F.col("low") != F.col("high")), "key", "left_semi").select("node", "label", "n").distinct()
    still = written(still.withColumn("id", F.monotonically_increasing_id()), "open-nodes")
    terms = bodies.join(still, "node").select("id", F.explode("shingles").alias("term"))
    common = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    spread = terms.join(common, "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("terms"))
    need = F.floor((percent * F.col("n") + 99) / 100)
    alone = F.col("n") - F.size("terms")
    take = (F.col("n") - need + 1 - alone).cast("int")
    prefix = written(
        spread.join(still, "id").filter(take > 0)
        .select("node", "label", "n", alone.alias("alone"), F.posexplode(F.slice("terms", F.lit(1), take)).alias("k", "t"))
        .select("node", "label", "n", (F.col("n") - F.col("alone") - F.col("k")).alias("left"), F.col("t.term").alias("term")),
        "prefixes",
    )
    names = ("node", "label", "n", "left")
    one, two = (prefix.select("term", *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in ("a", "b"))
    overlap = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    pairs = one.join(two, "term").filter(
        (F.col("node_a") > F.col("node_b"))
        & (F.col("label_a") != F.col("label_b"))
        & _sizes_fit(percent)
        & (F.least("left_a", "left_b") >= overlap)
    )
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(done, ["a", "b"], "left_anti")


def components_of(docs: DataFrame, percent: int = 80, width: int = 5, miss: float = 1e-6) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, text_hash, n_shingles, component_id, kept, stands``.

    Texts are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``width``-word shingles. A component's
    id is its smallest ``doc_id``; that document is kept.

    Tensored banding: each set gets two collections of ``m`` short keys (:func:`root_tables`), and every pair of a key of the
    first with a key of the second is a table, so ``m * m`` tables cost ``2 * m`` keys. Equal sets are one node from the start.
    Only keys that two nodes share are combined. In each table all nodes are compared with two centres; where this leaves
    several components in a table, the remaining pairs are found by an exact prefix filter. All links are confirmed on full sets.

    Null or empty text, or text without words: no shingles, linked with nothing, kept. Fewer words than ``width``: the whole
    sequence is the only shingle. Rows without ``doc_id`` link like others but do not name a component unless it has no id
    at all (then null); they are kept only there. Repeated rows share their component and ``kept``. ``stands`` marks the one text of
    each component, among those of the smallest id, that stands for it. Extra columns are ignored.
    """
    tables = root_tables(percent, miss)
    data = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    data = data.toDF("doc_id", "text_hash", "text")
    facts = written(
        data.mapInArrow(_describe(width, tables), "doc_id long, text_hash long, n long, set_id binary, keys array<long>"), "facts"
    )
    nodes = written(
        facts.filter(F.col("n") > 0).groupBy("set_id").agg(
            F.min(_node(F.col("doc_id"), F.col("text_hash"))).alias("node"), F.first("n").alias("n"),
            F.first("keys").alias("keys"), F.count(F.lit(1)).alias("_rows"),
        ),
        "nodes",
    )

    single = nodes.select("node", "n", F.posexplode("keys").alias("place", "root"))
    shared = single.groupBy("root").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).select("root")
    roots = single.join(shared, "root", "left_semi").groupBy("node", "n").agg(
        F.collect_list(F.when(F.col("place") < tables, F.col("root"))).alias("first"),
        F.collect_list(F.when(F.col("place") >= tables, F.col("root"))).alias("second"),
    )
    members = written(
        roots.select("node", "n", "second", F.explode("first").alias("f"))
        .select("node", "n", "f", F.explode("second").alias("s"))
        .select(F.xxhash64("f", "s").alias("key"), "node", "n"),
        "members",
    )
    whole = F.struct("node", "n")
    centres = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.min(whole).alias("one"), F.min(F.struct(F.xxhash64("node").alias("by"), "node", "n")).alias("two")
    ).filter(F.col("c") > 1)
    starred = members.join(centres, "key").select(
        F.col("node").alias("a"), F.col("n").alias("n_a"),
        F.explode(F.array(F.struct("one.node", "one.n"), F.struct("two.node", "two.n"))).alias("c"),
    ).select("a", "n_a", F.col("c.node").alias("b"), F.col("c.n").alias("n_b"))
    # a pair of two centres may come from both sides; the smaller node is then the centre
    stars = written(
        starred.filter((F.col("a") != F.col("b")) & _sizes_fit(percent)).select("a", "b").distinct(), "stars"
    )
    wanted = members.select("node").distinct()
    source = data.withColumn("node", _node(F.col("doc_id"), F.col("text_hash"))).select("node", "text")
    bodies = written(
        source.join(wanted, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(
            _sets(width), T.StructType([T.StructField("node", NODE), T.StructField("shingles", T.ArrayType(T.LongType()))])
        ),
        "bodies",
    )
    links = written(verify(stars, bodies, percent), "links")
    first = written(components(links), "labels")
    compared = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = written(_rest(members, first, bodies, compared, percent), "rest")
    more = written(verify(rest, bodies, percent), "more-links")
    labels = components(links.unionByName(more)) if more.head(1) else first

    label = F.coalesce("label", "node")
    side = written(nodes.join(labels, "node", "left").select("set_id", label.alias("label"), "_rows"), "component-ids")
    out = attach(facts.select("doc_id", "text_hash", "n", "set_id"), side, ["set_id"])
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif(F.col("label.d"), F.lit(NO_ID)))
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        ((F.col("n") == 0) | (F.col("label") == _node(F.col("doc_id"), F.col("text_hash")))).alias("stands"),
    )


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, miss: float = 1e-6) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of :func:`components_of`."""
    return components_of(docs, percent, width, miss).select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, miss: float = 1e-6) -> DataFrame:
    """One document of each component, with all columns; texts without words stay. Rows that repeat id and text are one."""
    text = F.coalesce("text", F.lit(""))
    keep = components_of(docs, percent, width, miss).filter("stands").select(_node(F.col("doc_id"), F.col("text_hash")).alias("node"))
    keep = written(keep.distinct(), "standing")
    rows = docs.select(F.struct(*docs.columns).alias("row"), _node(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("node"))
    return rows.join(keep, "node", "left_semi").dropDuplicates(["node"]).select("row.*")
