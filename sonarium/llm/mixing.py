"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.llm.common import SPACE, bucket_bits, running, written

BLOCK_WORDS = 64
MOST_EPOCHS = 3
SEED = "mix-1"

#: floor(2**64 / golden ratio): steps of it modulo 2**64 visit the circle most evenly.
GOLDEN = Decimal(11400714819323198485)
CIRCLE = Decimal(1 << 64)


def word_count(text: Column) -> Column:
    """Matches of ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(whole, SPACE), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = MOST_EPOCHS) -> DataFrame:
    """``key, source, source_size, weight, target``: sources in code point order (null last) weigh ``weights`` in turn.

    A target is the source's weight times one common level, but at most ``epochs`` times its size, and the targets add up to all
    sizes. The level follows from the sources in the order of size per weight. ``sizes`` has one row per source.
    """
    # one row per source, ordered over all sources: the table of sources, not of documents
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("weight", weight.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    earlier, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(all_rows)
    capped = F.coalesce(F.sum(epochs * F.col("source_size")).over(earlier), F.lit(0))
    free = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    # the level if exactly the earlier sources are at their limit; it is right from the first source that stays below its own
    level = (total - capped).cast("double") / free
    fits = F.when(F.col("weight") * level <= epochs * F.col("source_size"), level)
    chosen = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("weight") * chosen, (epochs * F.col("source_size")).cast("double"))
    return named.select("key", "source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``slot, key, rank``: which source fills each slot, and the rank of the slot in its source.

    Slot ``k`` takes the source on whose part of the weights, laid end to end, the fractional part of ``k`` times the golden
    ratio falls. A source gets exactly the slots for its target: slots it has too many are dropped, those it lacks (a few, as
    the sequence is even) follow at the end. Ranks are counted in runs of slots, so a heavy source is no single task.
    """
    spark = targets.sparkSession
    whole = F.sum("target").over(Window.partitionBy())
    part = F.sum("target").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / whole
    lanes = written(
        targets.filter(F.col("target") >= 0.5)
        .withColumn("high", part)
        .select("key", "high", F.ceil(F.floor(F.col("target") + 0.5) / block).cast("long").alias("need")),
        "lanes",
    )
    slots = lanes.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    k = spark.range(slots).withColumnRenamed("id", "slot")
    # the exact product modulo 2**64, brought to [0, 1): ANSI arithmetic would stop at the overflow of a long
    turn = F.pmod(F.col("slot").cast("decimal(20,0)") * F.lit(GOLDEN), F.lit(CIRCLE))
    k = k.withColumn("u", turn.cast("double") / F.lit(float(1 << 64)))
    # each lane is split at thousandths of the circle, so a point meets the lanes of its own thousandth only
    steps = 1000
    before = F.coalesce(F.lag("high").over(Window.orderBy("high", "key")), F.lit(0.0))
    cells = lanes.withColumn("low", before).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * steps), F.least(F.floor(F.col("high") * steps), F.lit(steps - 1))))
    )
    last = F.col("high") >= F.lit(1.0 - 1e-12)
    placed = (
        k.withColumn("cell", F.floor(F.col("u") * steps))
        .join(cells, "cell")
        .filter((F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | last))
        .select("slot", "key", "need")
    )
    placed = written(placed.withColumn("run", F.shiftright("slot", 14)), "placed")
    sums = placed.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "run", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "run").orderBy("slot")
    ranked = placed.join(starts, ["key", "run"]).withColumn("rank", F.col("start") + F.row_number().over(inside) - 1)
    have = placed.groupBy("key").agg(F.count(F.lit(1)).alias("have"))
    lacking = (
        lanes.join(have, "key", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter(F.col("have") < F.col("need"))
        .select(F.lit(slots).cast("long").alias("slot"), "key", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    )
    return ranked.filter(F.col("rank") < F.col("need")).select("slot", "key", "rank").unionByName(lacking)


def _shuffled(seed: str) -> Column:
    """A uniform hash of the document's id, from 0 to 2**63, in the order of the MD5 digest's first 15 hexadecimal digits."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.shiftleft(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), 3)


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), block: int = BLOCK_WORDS, epochs: int = MOST_EPOCHS, seed: str = SEED
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs (row, doc_id, source, size)`` and its pieces.

    Per source the documents are shuffled by a hash of ``seed`` and ``doc_id`` into one stream of words, repeated up to ``epochs``
    times and cut into blocks of ``block`` words. Block ``r`` of a source goes to the source's slot of rank ``r``
    (:func:`schedule`); the last block is cut so that the source gives its target to the word.

    Returns ``placed`` (``row, doc_id, key, size, source_size, target, at``) with one row per document, ``at`` being where its words begin in
    the stream, and ``pieces`` (``slot, key, at, epoch, start, length``), the words of the document at ``at`` that fill a slot.
    """
    rows = docs.withColumn("key", _source_key(F.col("source")))
    rows = written(rows.withColumn("_h", _shuffled(seed)), "mix-sizes")
    per_source = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(per_source, weights, epochs), "targets")
    bits = bucket_bits(rows.count())
    placed = running(rows, "key", "_h", ["doc_id", "size"], F.col("size"), "at", bits).drop("_h")
    placed = written(placed.join(targets.drop("source", "weight"), "key"), "streams")
    plan = schedule(targets, block)
    took = F.floor(F.col("target") + 0.5).cast("long")
    begin = F.col("at") + F.col("epoch") * F.col("source_size")
    end = F.least(begin + F.col("size"), took)
    # every document is listed once for each epoch and block that its words lie in
    parts = (
        placed.filter(F.col("size") > 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .filter(begin < took)
        .withColumn("begin", begin)
        .withColumn("end", end)
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    )
    low = F.greatest(F.col("begin"), F.col("rank") * block)
    high = F.least(F.col("end"), (F.col("rank") + 1) * block)
    pieces = parts.select(
        "key", "rank", "at", "epoch", (low - F.col("begin")).alias("start"), (high - low).alias("length")
    ).join(plan, ["key", "rank"])
    return placed, pieces.select("slot", "key", "at", "epoch", "start", "length")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """Per row of ``docs (doc_id, text, source)``: ``doc_id, size, source_size, target, taken, first_slot, slots``.

    ``first_slot`` is the place of the row's first words in the mixed order of blocks that :func:`schedule` gives, ``slots`` the number of
    blocks that hold words of it, repeats counted; null and 0 for rows the mix takes nothing of. Null text: size 0, nothing taken. Null source: a source of its own, last in order. Rows without id, or that repeat an id,
    are rows of their own; which of several rows with equal id and size comes first does not show in the result. Very long texts
    are counted whole and fill many blocks. An empty table gives no rows. Extra columns are ignored.
    """
    placed, pieces = mix(_sized(docs), **settings)
    taken = pieces.groupBy("key", "at").agg(F.sum("length").alias("words"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("slots"))
    has_words = F.col("size") > 0
    words = F.when(has_words, F.coalesce("words", F.lit(0))).otherwise(0)
    return placed.join(taken, ["key", "at"], "left").select(
        "doc_id", "size", "source_size", "target", words.cast("long").alias("taken"), F.when(has_words, F.col("first_slot")).alias("first_slot"),
        F.when(has_words, F.coalesce("slots", F.lit(0))).otherwise(0).cast("long").alias("slots"),
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    skipped = text.rlike("^" + SPACE).cast("int")
    rest = F.get(F.split(text, SPACE, (words + skipped + 1).cast("int")), (words + skipped).cast("int"))
    cut = F.substr(text, F.lit(1), F.length(text) - F.coalesce(F.length(rest), F.lit(0)))
    return F.regexp_replace(cut, SPACE + r"\z", "")


def draw_mix(docs: DataFrame, ordered: bool = False, **settings) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per document and epoch, cut to the words that the mix takes.

    With ``ordered`` the rows stand in the order of the schedule, a document where its first block does: every prefix of the corpus
    then has the sources' shares of words, up to the blocks of the documents begun in it. That takes one more shuffle of the texts.
    Only the document at which a source reaches its target is cut; a column ``n_chars`` follows the text. Documents without words
    are not drawn. Rows that repeat id and text are drawn as often as the schedule takes each of them.
    """
    text = F.coalesce("text", F.lit(""))
    node = F.struct(F.col("doc_id").alias("d"), F.xxhash64(text).alias("h"))
    sized = docs.select(node.alias("node"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    placed, pieces = mix(sized, **settings)
    taken = pieces.groupBy("key", "at", "epoch").agg(F.sum("length").alias("words"), F.min("slot").alias("slot"))
    drawn = written(
        placed.filter(F.col("size") > 0).join(taken, ["key", "at"]).select("node", "epoch", "words", "size", "slot"), "drawn"
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), node.alias("node")).dropDuplicates(["node"])
    both = rows.join(drawn, "node")
    both = both.orderBy("slot", "node", "epoch") if ordered else both
    changed = F.when(F.col("words") < F.col("size"), first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    new = {"text": changed, "n_chars": F.length(changed).cast("long")}
    return both.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
