"""Quality rules: text statistics, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.common import SPACE, UPPER, let, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
KINDS_BLOCK = 512
BROADCAST_GROUPS = 10_000

#: Smallest standard deviation used for each transformed statistic: steps below it are no sign of a bad text.
FLOORS = {"z_length": 0.1, "z_symbols": 0.05, "z_lines": 0.15, "z_repeats": 0.15, "z_upper": 0.05, "z_kinds": 0.05}
FEATURES = tuple(FLOORS)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW)))
    )

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def twice(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda e, k: (
                            F.coalesce(F.get(s, k + 1).v == e.v, F.lit(False))
                            | ((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0))).v == e.v))
                        ),
                    ),
                    lambda e: e.i,
                )
            ),
        )

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(twice(h), covered)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(some)


def _variety(words: Column) -> Column:
    """Exponent of the kinds of words in ``KINDS_BLOCK`` consecutive words, the mean over the words of the whole text."""

    def weighted(part: Column) -> Column:
        return F.size(part) * F.log1p(F.size(F.array_distinct(part)).cast("double")) / F.log1p(F.size(part).cast("double"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / KINDS_BLOCK).cast("int"))
    parts = F.transform(blocks, lambda b: weighted(F.slice(words, b * KINDS_BLOCK + 1, F.lit(KINDS_BLOCK))))
    return F.when(F.size(words) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(words)).otherwise(0.0)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds one struct column ``_q`` with the statistics of the whole text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    with_word = let(
        F.filter(F.split(whole, "\n"), lambda line: F.length(_without(line, BLANKS)) > 0),
        lambda lines: F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        ),
    )
    by_word = let(
        F.filter(F.split(whole, SPACE), lambda w: w != ""),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            _variety(words).alias("variety"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        ),
    )
    return docs.withColumn(
        "_q",
        let(
            F.struct(with_word.alias("l"), by_word.alias("w")),
            lambda s: F.struct(
                s.w.n_words.alias("n_words"),
                F.length(_without(whole, BLANKS)).cast("long").alias("word_chars"),
                (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("long").alias("n_symbols"),
                s.l.n_dup_lines.alias("n_dup_lines"),
                s.w.n_repeat_words.alias("n_repeat_words"),
                s.w.variety.alias("variety"),
                s.l.n_lines.alias("n_lines"),
                (F.length(whole) - F.length(_without(whole, UPPER))).cast("long").alias("n_upper"),
            ),
        ),
    )


def _features(q: str = "_q") -> dict[str, Column]:
    def col(name: str) -> Column:
        return F.col(f"{q}.{name}").cast("double")

    def share(a: str, b: str) -> Column:
        return F.sqrt(col(a) / F.greatest(col(b), F.lit(1.0)))

    words = F.greatest(col("n_words"), F.lit(1.0))
    # the length of a text is no sign of its quality, so every statistic is free of it
    return {
        "z_length": F.log1p(col("word_chars") / words),
        "z_symbols": share("n_symbols", "word_chars"),
        "z_lines": share("n_dup_lines", "n_lines"),
        "z_repeats": share("n_repeat_words", "n_words"),
        "z_upper": share("n_upper", "word_chars"),
        # a text holds fewer kinds of words in proportion the longer it is, so they are counted in blocks
        "z_kinds": col("variety"),
    }


def chi_square(p: int, z: float) -> float:
    """Quantile of the chi-square law at the normal quantile ``z`` (Wilson and Hilferty's approximation)."""
    return p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3


def _invert(params: DataFrame, p: int) -> DataFrame:
    """Rows of the inverse Cholesky factor ``w{i}_{j}`` of each group's covariance ``c{i}_{j}``, and ``logdet``."""
    for j in range(p):
        rest = reduce(lambda a, b: a - b, [F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") for k in range(j)], F.col(f"c{j}_{j}"))
        params = params.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))))
        params = params.withColumns(
            {
                f"l{i}_{j}": reduce(
                    lambda a, b: a - b, [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)], F.col(f"c{j}_{i}")
                )
                / F.col(f"l{j}_{j}")
                for i in range(j + 1, p)
            }
        )
    for j in range(p):
        params = params.withColumn(f"w{j}_{j}", 1 / F.col(f"l{j}_{j}"))
        for i in range(j + 1, p):
            total = reduce(lambda a, b: a + b, [F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)])
            params = params.withColumn(f"w{i}_{j}", -total / F.col(f"l{i}_{i}"))
    return params


def _distance(p: int) -> Column:
    centred = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    terms = []
    for i in range(p):
        y = reduce(lambda a, b: a + b, [F.col(f"w{i}_{j}") * centred[j] for j in range(i + 1)])
        terms.append(F.pow(y, 2.0))
    return reduce(lambda a, b: a + b, terms)


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """``lang, source, cell``: a pair with few rows joins its language's other small pairs, then all that are left."""
    named = F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in ("lang", "source")])
    pairs = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = pairs.filter(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("together"))
    spoken = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))
    return pairs.join(small.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").select(
        "lang",
        "source",
        F.when(F.col("n") >= least, named).when(F.col("together") >= least, spoken).otherwise("").alias("cell"),
    )


def reject_outliers(
    docs: DataFrame, half: float = 0.75, steps: int = 4, cut: float = 4.5, least: int = 100, accuracy: int = 10_000
) -> DataFrame:
    """``docs`` (with ``lang``, ``source`` and the statistics ``_q``) with the squared distance ``_d2`` and ``_inlier``.

    Minimum covariance determinant per language and source: from the coordinatewise medians, ``steps`` concentration steps keep
    the ``half`` of the group that is nearest and take its mean and covariance again. The distances are scaled so that their
    median is that of the chi-square law; a row beyond the law's quantile at ``cut`` standard deviations is an outlier.
    Every step is two grouped aggregations over a narrow table of all documents; quantiles are mergeable sketches, so a group
    with most of the rows is reduced before the shuffle. Groups under ``least`` rows are pooled (:func:`_groups`).
    """
    p = len(FEATURES)
    z = docs.select("*", *[c.alias(n) for n, c in _features().items()])
    cells = written(_groups(docs, least).withColumnsRenamed({"lang": "_l", "source": "_s"}), "cells")
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_GROUPS else cells
    z = z.join(cells, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")
    z = written(z, "statistics")
    quartiles = z.groupBy("cell").agg(*[F.percentile_approx(f, [0.25, 0.5, 0.75], accuracy).alias(f"q_{f}") for f in FEATURES])
    start = quartiles.select(
        "cell",
        *[F.col(f"q_{f}")[1].alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[
            (F.pow(F.greatest((F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0]) / 1.349, F.lit(FLOORS[f])), 2.0) if i == j else F.lit(0.0)).alias(f"c{i}_{j}")
            for i, f in enumerate(FEATURES)
            for j in range(i, p)
        ],
    )
    held = ["cell", *[f"m{i}" for i in range(p)], *[f"w{i}_{j}" for i in range(p) for j in range(i + 1)]]
    params = written(_invert(start, p).select(*held), "mcd-start")
    # one row per group: broadcast while the groups are few, so that no row of the documents is shuffled by its group
    few = params.count() <= BROADCAST_GROUPS

    def by_cell(side: DataFrame) -> DataFrame:
        return z.join(F.broadcast(side) if few else side, "cell")

    for _ in range(steps):
        near = by_cell(params).withColumn("_d2", _distance(p))
        bound = near.groupBy("cell").agg(F.percentile_approx("_d2", half, accuracy).alias("_bound"))
        bound = written(params.join(bound, "cell"), "mcd-bound")
        kept = by_cell(bound).withColumn("_d2", _distance(p)).filter(F.col("_d2") <= F.col("_bound"))
        # sums are taken around the last centre, where they lose no digits
        shifted = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
        sums = kept.groupBy("cell").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.first(f"m{i}").alias(f"o{i}") for i in range(p)],
            *[F.sum(shifted[i]).alias(f"s{i}") for i in range(p)],
            *[F.sum(shifted[i] * shifted[j]).alias(f"t{i}_{j}") for i in range(p) for j in range(i, p)],
        )
        moments = sums.select(
            "cell",
            *[(F.col(f"o{i}") + F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(p)],
            *[
                (
                    F.col(f"t{i}_{j}") / F.col("n")
                    - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n")
                    + (FLOORS[FEATURES[i]] ** 2 if i == j else 0.0)
                ).alias(f"c{i}_{j}")
                for i in range(p)
                for j in range(i, p)
            ],
        )
        params = written(_invert(moments, p).select(*held), "mcd-step")
    near = by_cell(params).withColumn("_d2", _distance(p))
    middle = written(near.groupBy("cell").agg(F.percentile_approx("_d2", 0.5, accuracy).alias("_middle")), "mcd-scale")
    scale = F.greatest(F.col("_middle") / chi_square(p, 0.0), F.lit(1.0))
    out = by_cell(params.join(middle, "cell")).withColumn("_d2", _distance(p) / scale)
    return out.withColumn("_inlier", F.col("_d2") <= chi_square(p, cut)).select(*docs.columns, "_d2", "_inlier")


BASE_WORDS = 20
BASE_REPEATS = 30


def _base_failed() -> Column:
    return (F.col("_q.n_words") < BASE_WORDS) | (100 * F.col("_q.n_repeat_words") > BASE_REPEATS * F.col("_q.n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text, lang, source)``: its statistics, ``base_failed``, the distance and ``kept``.

    Kept are texts that pass the base rules and are no outliers of their language and source. Null text: no words, so the base
    rules fail. Null language or source: a group of its own. Repeated rows are judged alike. An empty table gives no rows, and
    extra columns are ignored. Whole texts of any length are read, in the JVM, row by row.
    """
    narrow = text_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text")
    judged = reject_outliers(narrow).withColumn("base_failed", _base_failed())
    return judged.select(
        "doc_id",
        *[F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        (~F.col("base_failed") & F.col("_inlier")).alias("kept"),
        F.col("_d2").alias("distance2"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", "text")
    narrow = text_statistics(rows).drop("text")
    return reject_outliers(narrow).filter(~_base_failed() & F.col("_inlier")).select("row.*")
