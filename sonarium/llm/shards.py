"""Sharding by balanced label propagation: linked documents move to one shard while row counts stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.llm.common import attach, bucket_bits, running, written

SHARDS = 16
ROUNDS = 4
CHUNKS = 2


def propagate(links: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``hub, shard, n``: how many members of each hub belong in each shard.

    ``links`` has ``(hub, shard, n)``: a hub joins documents that should meet, ``n`` of its members carry the label ``shard``. In
    each round the members of a hub look at their neighbours: the label that most of them carry, among the shards with room for
    all (ties by a hash, so that no shard is preferred), spreads to the others, as far as the shard's quota goes. Hubs are admitted
    the larger first, then in a hashed order, while their running demand fits what ``capacity`` leaves; a hub that is refused looks
    again in the next round. What is refused to the end keeps its first labels. Members move in counts per hub and shard, so a
    hub of any size is at most one row for each shard.
    """
    hubs = links.groupBy("hub").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held")
    )
    hubs = written(hubs.withColumn("home", F.lit(None).cast("int")), "hubs")
    bits = bucket_bits(hubs.count())
    every = hubs.sparkSession.range(shards).select(F.col("id").cast("int").alias("home"))
    for turn in range(rounds):
        settled, open_hubs = hubs.filter(F.col("home").isNotNull()), hubs.filter(F.col("home").isNull())
        load = settled.groupBy("home").agg(F.sum("size").alias("load"))
        room = every.join(load, "home", "left").select("home", (F.lit(capacity) - F.coalesce("load", F.lit(0))).alias("room"))
        # one row with an entry for each shard
        rooms = room.agg(F.map_from_entries(F.collect_list(F.struct("home", "room"))).alias("rooms"))
        seen = open_hubs.withColumn("rooms", rooms.scalar())

        def wish(s: Column, turn: int = turn) -> Column:
            here = F.coalesce(F.element_at("held", s), F.lit(0).cast("long"))
            free = F.element_at("rooms", s) >= F.col("size")
            return F.struct(free.alias("free"), here.alias("here"), F.xxhash64("hub", s, F.lit(turn)).alias("by"), s.alias("shard"))

        best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), wish))
        large_first = F.shiftleft(63 - F.floor(F.log2(F.col("size").cast("double"))).cast("long"), 57)
        movers = seen.withColumn("best", best).select(
            "hub", "size", "held", F.col("best.shard").alias("to"), F.element_at("rooms", F.col("best.shard")).alias("room"),
            large_first.bitwiseOR(F.shiftrightunsigned(F.xxhash64("hub", F.lit("turn")), 7)).alias("_h"),
        )
        ordered = running(movers, "to", "_h", ["hub"], F.col("size"), "earlier", bits)
        home = F.when(F.col("earlier") + F.col("size") <= F.col("room"), F.col("to"))
        moved = ordered.select("hub", "size", "held", home.alias("home"))
        hubs = written(settled.unionByName(moved), "hubs")
    final = F.when(F.col("home").isNull(), F.col("held")).otherwise(F.create_map("home", "size"))
    return hubs.select("hub", F.explode(final).alias("shard", "n"))


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (a settled table with ``rid``, unique, and ``digest``) with ``shard`` and ``slot``.

    Documents with equal ``digest`` are linked through a hub. A group above half a shard is first cut into hubs of about
    that size. After :func:`propagate`, what exceeds a shard's quota of rows is released, and released and unlinked documents
    fill the quotas, in a hashed order. Quotas differ by one row at most, so the counts of the shards do.
    """
    total = docs.count()
    quota = [total // shards + (1 if s < total % shards else 0) for s in range(shards)]
    chunk = max(total // (shards * CHUNKS), 1)
    groups = written(docs.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows")), "groups")
    side = groups.filter(F.col("_rows") > 1).select("digest", "_rows", F.ceil(F.col("_rows") / chunk).cast("int").alias("cuts"))
    rows = attach(docs, side, ["digest"])
    spread = F.xxhash64("rid", F.lit("part"))
    rows = rows.withColumn("hub", F.when(F.col("cuts").isNotNull(), F.xxhash64("digest", F.pmod(spread, "cuts"))))
    rows = rows.withColumn("first", F.pmod(F.xxhash64("rid", F.lit("start")), F.lit(shards)).cast("int"))
    rows = written(rows.select(*docs.columns, "hub", "first", "cuts"), "shard-rows")
    linked = rows.filter(F.col("hub").isNotNull())
    links = linked.groupBy("hub", F.col("first").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = written(propagate(links, min(quota), shards, rounds), "cells")

    # a hub's members take its cells in order: first those of the first cell, and so on
    bits = bucket_bits(total)
    hub_first = Window.partitionBy("hub").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bounds = cells.withColumn("low", F.coalesce(F.sum("n").over(hub_first), F.lit(0)))
    bounds = bounds.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("low", "n", "shard"))).alias("cells"), F.sum("n").alias("_rows"))
    placed = written(attach(written(linked.drop("cuts"), "linked"), written(bounds, "bounds"), ["hub"]), "hub-rows")
    order = F.xxhash64("rid", F.lit("order"))
    one = running(placed.filter(F.size("cells") > 1).withColumn("_h", order), "hub", "_h", ["rid"], F.lit(1), "k", bits)
    cell = F.element_at(F.filter("cells", lambda c: c.low <= F.col("k")), -1)
    wanted = placed.filter(F.size("cells") == 1).withColumn("to", F.col("cells")[0].shard).select(*docs.columns, "to")
    wanted = wanted.unionByName(one.withColumn("to", cell.shard).select(*docs.columns, "to"))
    wanted = written(wanted.withColumn("_h", F.xxhash64("rid", F.lit("order"))), "wanted")

    def quotas(name: str) -> Column:
        return F.element_at(F.array(*[F.lit(q).cast("long") for q in quota]), F.col(name) + 1)

    numbered = written(running(wanted, "to", "_h", ["rid"], F.lit(1), "slot", bits), "numbered")
    fits = numbered.filter(F.col("slot") < quotas("to"))
    over = numbered.filter(F.col("slot") >= quotas("to")).select(*docs.columns)
    free = over.unionByName(rows.filter(F.col("hub").isNull()).select(*docs.columns)).withColumn("_h", order)
    free = running(free.withColumn("all", F.lit(0)), "all", "_h", ["rid"], F.lit(1), "k", bits)
    # one row per shard: how many places it has left, laid end to end
    taken = fits.groupBy("to").agg(F.count(F.lit(1)).alias("taken"))
    every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("to"))
    gaps = every.join(taken, "to", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    gaps = gaps.withColumn("gap", quotas("to") - F.col("taken"))
    low = F.coalesce(F.sum("gap").over(Window.orderBy("to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = gaps.withColumn("low", low).agg(F.array_sort(F.collect_list(F.struct("low", "gap", "taken", "to"))).alias("gaps"))
    filled = free.withColumn("gaps", written(gaps, "gaps").scalar()).withColumn(
        "g", F.get(F.filter("gaps", lambda g: (g.low <= F.col("k")) & (F.col("k") < g.low + g.gap)), F.lit(0))
    )
    late = filled.select(*docs.columns, F.col("g.to").alias("shard"), (F.col("k") - F.col("g.low") + F.col("g.taken")).alias("slot"))
    return fits.select(*docs.columns, F.col("to").alias("shard"), F.col("slot").cast("long")).unionByName(
        late.select(*docs.columns, "shard", F.col("slot").cast("long"))
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: the shards' counts differ by one at most. ``slot`` counts a shard's rows from 0 without gaps, and
    ``grown_shard`` is null. Linked are documents with equal texts. Null text: size 1, CRC of nothing, linked with empty texts.
    Repeated rows are documents of their own. With fewer rows than shards, some shards stay empty. Extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"),
    )
    rows = written(narrow.withColumn("rid", F.monotonically_increasing_id()), "shard-sizes")
    return assign(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
