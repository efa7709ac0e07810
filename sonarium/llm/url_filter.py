"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the other URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.common import UPPER, let, written

#: (verdict, rule): what the host must be or end in, up to the first slash, and what the path must begin with, from it.
Rule = tuple[str, str]

RULES: tuple[Rule, ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Most labelled URLs that the trees are trained on.
TRAIN_ROWS = 20_000


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both are empty for null and where ``://`` is missing."""
    whole = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.substr(whole, F.instr(whole, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, UPPER, UPPER.lower()), "path": path})


def rule_of(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, else null. The list is part of the plan, so keep it short."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[1]))

    def fits(rule: str) -> Column:
        where, at = rule.split("/", 1)
        return ((F.col(host) == where) | F.col(host).endswith("." + where)) & F.col(path).startswith("/" + at)

    found = [F.when(fits(r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for v, r in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, n: a - n / F.length(text) * F.log2(n / F.length(text)))

    kinds = F.array_distinct(F.split(text, ""))
    counts = F.transform(F.filter(kinds, lambda c: c != ""), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    return F.when(F.length(text) > 0, let(counts, total)).otherwise(0.0)


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


LEXICAL = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "url_digits", "host_digits", "host_hyphens", "url_entropy",
    "host_entropy", "parameters", "has_fragment", "secure", "suffix_blocked", "section_blocked",
)


def lexical_features(pages: DataFrame) -> DataFrame:
    """Adds the lexical features but the two statistics, and the keys of those: the host's suffix and the path's first section."""
    url = F.coalesce("url", F.lit(""))
    query = F.when(F.instr(url, "?") > 0, F.substring_index(F.substr(url, F.instr(url, "?") + 1), "#", 1)).otherwise("")
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    hyphens = F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))
    values = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "host_depth": dots,
        "path_depth": slashes,
        "url_digits": _digits(url) / F.greatest(F.length(url), F.lit(1)),
        "host_digits": _digits(F.col("host")) / F.greatest(F.length("host"), F.lit(1)),
        "host_hyphens": hyphens,
        "url_entropy": _entropy(url),
        "host_entropy": _entropy(F.col("host")),
        "parameters": F.when(query != "", F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1).otherwise(0),
        "has_fragment": F.instr(url, "#") > 0,
        "secure": F.lower(url).startswith("https:"),
    }
    keys = {
        "suffix": F.substring_index("host", ".", -1),
        "section": F.regexp_extract("path", r"^/([^/]*)/", 1),
    }
    return pages.withColumns({k: v.cast("double") for k, v in values.items()} | keys)


def _rates(labelled: DataFrame, key: str, smooth: float = 20.0) -> DataFrame:
    """Smoothed share of blocked URLs for each value of a key, over all labelled URLs."""
    whole = labelled.agg(F.coalesce(F.avg("blocked"), F.lit(0.5)).alias("mean"))
    counts = labelled.groupBy(key).agg(F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("n"))
    mean = whole.scalar()
    return counts.select(key, ((F.col("b") + smooth * mean) / (F.col("n") + smooth)).alias(f"{key}_blocked"))


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    for key, rate in rates.items():
        rows = rows.join(rate, key, "left").withColumn(f"{key}_blocked", F.coalesce(f"{key}_blocked", F.lit(0.5)))
    return rows


def train(labelled: DataFrame, most: int = TRAIN_ROWS, trees: int = 20, depth: int = 4) -> tuple[GBTClassificationModel | None, dict[str, DataFrame]]:
    """Boosted trees and the suffix statistics from ``labelled`` (lexical features and ``blocked``, 0.0 or 1.0).

    The statistics count all labelled URLs; the trees see ``most`` of them, those with the smallest hash of the URL. Without
    both labels there is no model.
    """
    rates = {key: written(_rates(labelled, key), f"rates-{key}") for key in ("suffix", "section")}
    chosen = labelled.orderBy(F.xxhash64("url"), "url").limit(most)
    rows = written(VectorAssembler(inputCols=list(LEXICAL), outputCol="features").transform(_with_rates(chosen, rates)), "url-training")
    if rows.select("blocked").distinct().count() < 2:
        return None, rates
    learner = GBTClassifier(featuresCol="features", labelCol="blocked", maxIter=trees, maxDepth=depth, seed=1, cacheNodeIds=False)
    return learner.fit(rows.select("features", "blocked")), rates


def score(rows: DataFrame, model: GBTClassificationModel | None, rates: dict[str, DataFrame]) -> DataFrame:
    """Adds ``probability`` of being blocked."""
    rated = _with_rates(rows, rates)
    if model is None:
        return rated.withColumn("probability", (F.col("suffix_blocked") + F.col("section_blocked")) / 2)
    ready = VectorAssembler(inputCols=list(LEXICAL), outputCol="features").transform(rated)
    columns = [*rated.columns]
    done = model.setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y").transform(ready)
    return done.select(*columns, vector_to_array("_p")[1].alias("probability"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, most: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``pages (page_id, url)``: ``page_id, host, path, rule, verdict, probability``.

    The longest fitting rule decides. The URLs that rules decide are the labelled ones: they train the trees, which judge the
    rest at a probability of one half. Null or odd URLs have an empty host and path and are judged by the trees too; empty tables
    give no rows; repeated rows are judged alike; extra columns are ignored.
    """
    narrow = with_host_and_path(pages.select("page_id", "url")).withColumn("_rule", rule_of(rules))
    rows = written(lexical_features(narrow), "url-features")
    labelled = rows.filter(F.col("_rule").isNotNull()).withColumn("blocked", (F.col("_rule.verdict") == "block").cast("double"))
    model, rates = train(labelled, most)
    judged = F.when(F.col("probability") >= 0.5, "block").otherwise("allow")
    return score(rows, model, rates).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", judged).alias("verdict"), "probability"
    )
