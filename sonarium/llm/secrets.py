"""Secret scan: candidate strings, their features, and a random forest that removes false positives."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.llm.common import UPPER, attach, let, written

LOWER = UPPER.lower()
DIGITS = "0123456789"

#: Words that name a credential, looked for before a candidate.
NAMING = r"(?i:token|secret|passw(?:or)?d|api[_\-]?key|access[_\-]?key|private[_\-]?key|credential|bearer|auth)"

_RUN = r"[A-Za-z0-9+/_\-]"
_NAME = r"[A-Za-z0-9+/_.\-]"
_ASSIGN = r"[\"'`]?\s{0,8}+(?::=|=>|={1,3}+|:)\s{0,8}+"
#: A name that holds a naming word, up to the value assigned to it.
_NAMED = rf"(?<!{_NAME})(?={_NAME}++{_ASSIGN}){_NAME}*?{NAMING}{_NAME}*+{_ASSIGN}(?:(?i:bearer|basic|token)\s++)?+"
#: A name in one run with its value, without blanks.
_JOINED = rf"(?<!{_RUN})[A-Za-z0-9_\-]{{1,15}}+=++(?={_RUN})"
_VALUE = r"(?:\"[^\"\n]+(?=\")|'[^'\n]+(?=')|`[^`\n]+(?=`)|[^\s\"'`]*[^\s\"'`,;.:)\]}>])"

#: The user of a URL and its ``:``, up to the password.
_USER = r"://[^\s/:@]{1,64}+:"
#: Runs joined by dots, as signed tokens are.
_DOTTED = rf"(?<!{_RUN})[A-Za-z0-9_\-]{{2,}}+(?:\.[A-Za-z0-9_\-]{{16,}}+)+"

#: What is looked at: the value behind a naming word, of any length and characters; the password of a URL; runs joined by dots; a value in a run
#: of 16 or more with its name; a whole run of 16 or more. A name and its ``=`` or ``:`` are no part of the candidate (:func:`_name_length`).
CANDIDATE = (
    rf"{_NAMED}{_VALUE}|{_USER}[^\s/@]+(?=@)|{_DOTTED}|(?<!{_RUN})(?=[A-Za-z0-9+/_=\-]{{16}}){_JOINED}{_RUN}+={{0,2}}(?!{_RUN})"
    rf"|(?<!{_RUN}){_RUN}{{16,}}+(?:={{1,2}}(?!{_RUN}))?|(?<={_RUN}{{16}}={{1,2}}){_RUN}++={{0,2}}"
)
#: Every naming word in lower case as it is found without a pattern.
_NAMING_WORDS = ("token", "secret", "passw", "api", "access", "private", "credential", "bearer", "auth")
CONTEXT = 48
#: No found place is shorter, its name included, so that so many of them and their gaps hold the context.
_NEAREST = CONTEXT // 6 + 1
DICTIONARY_WORDS = 200
TRAIN_ROWS = 20_000
MASK = "[secret removed]"


def _gaps_and_candidates(text: Column) -> tuple[Column, Column]:
    return F.split(text, CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def common_words(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent letter words of 3 to 12 characters in all texts, at most ``words`` of them."""
    return _most_frequent(word_counts(docs), words)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, count``: every word of 3 letters or more that stands by itself in a text."""
    each = docs.select(F.explode(F.split(F.lower("text"), r"[\s\p{P}]+")).alias("word"))
    return each.filter(F.col("word").rlike(r"^\p{L}{3,}$")).groupBy("word").count()


def _most_frequent(counts: DataFrame, words: int) -> list[str]:
    short = counts.filter(F.length("word") <= 12)
    return [r["word"] for r in short.orderBy(F.col("count").desc(), "word").limit(words).collect()]


def _name_length(hit: Column) -> Column:
    """Characters of a found place before its candidate: the name, its ``=`` or ``:`` and an opening quote."""
    return F.length(F.regexp_extract(hit, rf"^(?:{_NAMED}[\"'`]?(?=.)|{_JOINED}|{_USER})", 0))


def may_hold_candidates(text: Column) -> Column:
    """False for most texts without candidates: no long run, no naming word and no user in a URL. Far cheaper than the pattern itself."""
    low = F.lower(text)
    found = text.rlike(rf"(?<!{_RUN}){_RUN}{{16}}") | (text.contains("://") & text.contains("@"))
    for word in _NAMING_WORDS:
        found = found | low.contains(word)
    return found | (text.contains(".") & text.rlike(_DOTTED))


#: Length of the runs by which sums over a text's candidates are taken, so that their cost stays near their number.
_RUN_OF_SUMS = 256


def _add(values: Column, low: Column, end: Column) -> Column:
    places = F.when(low < end, F.sequence(low, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda s, k: s + F.get(values, k))


def _starts(gaps: Column, hits: Column) -> Column:
    """Position of each found place: the lengths of what stands before it, by sums of whole runs of places and of the rest of one run."""
    lengths = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))

    def places(each: Column) -> Column:
        n = F.size(each)
        runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _RUN_OF_SUMS).cast("int")), lambda r: _add(each, r * _RUN_OF_SUMS, F.least((r + 1) * _RUN_OF_SUMS, n)))

        def over(totals: Column) -> Column:
            before = F.transform(totals, lambda _, r: _add(totals, F.lit(0), r))
            return let(
                before,
                lambda first: F.transform(
                    each, lambda _, i: F.get(first, F.floor(i / _RUN_OF_SUMS).cast("int")) + _add(each, i - i % _RUN_OF_SUMS, i) + F.length(F.get(gaps, i))
                ),
            )

        return let(runs, over)

    return let(lengths, places)


def candidates(docs: DataFrame) -> DataFrame:
    """``node, path, place, start, candidate, before, after``: every candidate of whole texts with what stands around it.

    Work and memory grow with the text and the number of its candidates, however many there are.
    """

    def found(gaps: Column, hits: Column) -> Column:
        def span(low: Column, high: Column) -> Column:
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        def around(i: Column) -> tuple[Column, Column]:
            """The last characters before, and the first behind, the found place."""
            left = F.transform(span(F.greatest(i - _NEAREST, F.lit(0)), i - 1), lambda k: F.concat(F.right(F.get(gaps, k), F.lit(CONTEXT)), F.right(F.get(hits, k), F.lit(CONTEXT))))
            right = F.transform(
                span(i + 1, F.least(i + _NEAREST, F.size(hits) - 1)), lambda k: F.concat(F.left(F.get(hits, k), F.lit(CONTEXT)), F.left(F.get(gaps, k + 1), F.lit(CONTEXT)))
            )
            return (
                F.concat(F.array_join(left, ""), F.right(F.get(gaps, i), F.lit(CONTEXT))),
                F.concat(F.left(F.get(gaps, i + 1), F.lit(CONTEXT)), F.array_join(right, "")),
            )

        def place(start: Column, i: Column, name: Column) -> Column:
            hit, (left, right) = F.get(hits, i), around(i)
            return F.struct(
                i.alias("place"),
                (start + name).alias("start"),
                F.substring(hit, name + 1, F.length(hit)).alias("candidate"),
                F.right(F.concat(left, F.left(hit, name)), F.greatest(name, F.lit(CONTEXT))).alias("before"),
                F.left(right, F.lit(CONTEXT)).alias("after"),
            )

        each = let(
            _starts(gaps, hits),
            lambda starts: F.transform(starts, lambda start, i: let(_name_length(F.get(hits, i)), lambda name: place(start, i, name))),
        )
        return F.when(F.size(hits) > 0, each)

    gaps, hits = _gaps_and_candidates(F.col("text"))
    some = docs.filter(may_hold_candidates(F.col("text"))).select(
        "node", "path", F.explode(let(F.struct(gaps.alias("g"), hits.alias("h")), lambda s: found(s.g, s.h))).alias("c")
    )
    return some.select("node", "path", "c.*")


def _share(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.length(text), F.lit(1))


def _runs(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(.)\1*", "x"))


def _entropy(text: Column) -> Column:
    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    shares = F.transform(kinds, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    return F.aggregate(shares, F.lit(0.0), lambda a, x: a - x * F.log2(x))


#: Words that name a digest or an identifier, which is no secret.
HASH_NAMING = r"(?i:commit|revision|sha-?\d|md5|hash|digest|checksum|uuid|guid|etag)[^\n]{0,12}$"

FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "entropy", "class_changes", "vowel_changes", "coverage", "hexadecimal",
    "path_length", "path_depth", "path_is_sample", "named", "assigned", "quoted", "words_before", "words_after", "hash_named", "in_url", "own_line",
)


#: A word counts as one of the corpus from so many places on.
KNOWN_COUNT = 3


def _with_known_parts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``_known``, the characters of the candidate's word parts (cut at capitals, digits and signs) that are words of the corpus."""
    each = written(rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("_rows")), "distinct-candidates")
    part = F.regexp_extract_all("candidate", F.lit(r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"), F.lit(0))
    parts = written(each.select("candidate", F.explode(part).alias("word")).withColumn("word", F.lower("word")), "word-parts")
    words = counts.filter(F.col("count") >= KNOWN_COUNT).select("word", F.length("word").alias("_chars"))
    words = written(parts.groupBy("word").agg(F.count(F.lit(1)).alias("_rows")).join(words, "word"), "known-parts")
    known = attach(parts, words, ["word"]).groupBy("candidate").agg(F.coalesce(F.sum("_chars"), F.lit(0)).alias("_known"))
    return attach(rows, written(each.join(known, "candidate"), "known-characters"), ["candidate"])


def with_features(rows: DataFrame, dictionary: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Adds length, character shares and transitions, dictionary coverage, path and neighbourhood of each candidate."""
    c, size = F.col("candidate"), F.length("candidate")
    classes = F.translate(c, LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    vowels = F.translate(F.lower(c), "aeiou" + "bcdfghjklmnpqrstvwxyz", "v" * 5 + "c" * 21)
    path = F.coalesce("path", F.lit(""))
    # longer words first, so that a word inside a longer one does not break it
    words = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    covered = 1 - F.length(F.regexp_replace(F.lower(c), words, "")) / size if words else F.lit(0.0)
    if counts is not None:
        # run-together words show by the most frequent words only, parts by all words
        rows = _with_known_parts(rows, counts)
        covered = F.greatest(covered, F.coalesce("_known", F.lit(0)) / size)
    values = {
        "length": size,
        "digits": _share(c, DIGITS),
        "uppers": _share(c, UPPER),
        "lowers": _share(c, LOWER),
        "others": _share(c, "+/_=-."),
        "entropy": _entropy(c),
        "class_changes": _runs(classes) / size,
        "vowel_changes": _runs(vowels) / size,
        "coverage": covered,
        "hexadecimal": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "path_length": F.length(path),
        "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "path_is_sample": F.lower(path).rlike("test|example|sample|doc"),
        "named": F.col("before").rlike(NAMING),
        "assigned": F.col("before").rlike(r"[=:]>?\s*(?:(?i:bearer|basic|token)\s+)?[\"'`]?$"),
        "quoted": F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]"),
        "hash_named": F.col("before").rlike(HASH_NAMING),
        "in_url": F.col("before").rlike(rf"{_USER}$") & F.col("after").startswith("@"),
        "own_line": F.col("before").rlike(r"\n$") & F.col("after").rlike(r"^(?:\n|$)"),
        "words_before": F.size(F.split("before", r"\s+")),
        "words_after": F.size(F.split("after", r"\s+")),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()}).drop("_known")


def rule_labels() -> Column:
    """Labels of real findings whose shape leaves no doubt, else null: 1.0 for a mixed string assigned to a named credential, 0.0 for words, numbers, dates and paths of words.

    A bare string that could be a secret gets no label here; what such strings look like the forest learns from :func:`planted_findings`.
    """
    named, assigned, c = F.col("named") > 0, F.col("assigned") > 0, F.col("candidate")
    mixed = (F.col("digits") > 0.1) & (F.col("digits") < 0.95) & (F.col("entropy") > 3.0)
    words = c.rlike(r"^\p{Lu}?\p{Ll}*(?:[-_/. ,'+=]+\p{Lu}?\p{Ll}*)*$|^\p{Lu}+$")
    numbers = c.rlike(r"^[\d\-/+_.:=T]+$")
    return F.when(named & assigned & mixed, 1.0).when(words | (numbers & ~(named & assigned)), 0.0)


#: Forms of planted findings: what the candidate, the text before and the text behind it are made of.
PLANTED_SECRETS = ("aws", "github", "slack", "stripe", "url", "jwt", "pem", "env", "bare", "quoted", "password", "dotted")
PLANTED_CLEAN = ("commit", "checksum", "uuid", "number", "snake", "path", "prose", "stamp")


def planted_findings(found: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled findings: the surroundings of real candidates with another string in the candidate's place, and its ``secret``.

    Secrets are the usual key, token, key-block and password forms filled from digests; clean ones are digests and identifiers that are called so, numbers,
    and names made of the words that stand around. The rows are those with the smallest hash.
    """
    forms = (*PLANTED_SECRETS, *PLANTED_CLEAN)
    order = [F.xxhash64("candidate", "before", "after"), "candidate", "before", "start"]
    some = found.orderBy(*order).limit(-(-most // len(forms)))
    seed = F.concat_ws("/", "candidate", "before", F.col("start").cast("string"), "form")
    rows = some.withColumn("form", F.explode(F.array(*[F.lit(f) for f in forms])))
    # digests of the place: bytes as hexadecimal digits and in base 64
    rows = rows.withColumn("_x", F.sha2(seed, 512)).withColumn("_b", F.base64(F.unhex(F.concat("_x", F.sha2(F.concat(seed, F.lit("+")), 512)))))
    rows = rows.withColumn("_a", F.regexp_replace("_b", "[^A-Za-z0-9]", "")).withColumn("_d", F.regexp_replace(F.concat("_x", "_x"), "[^0-9]", ""))
    size = F.pmod(F.xxhash64("_x"), F.lit(25)).cast("int")

    def alnum(start: int, n: int | Column) -> Column:
        return F.substring("_a", F.lit(start), F.lit(n) if isinstance(n, int) else n)

    hexa, word = lambda n: F.left("_x", F.lit(n)), F.regexp_extract("before", r"(\p{Ll}{2,})", 1)
    other = F.regexp_extract("after", r"(\p{Ll}{2,})", 1)
    tail, quiet = F.right("before", F.lit(24)), F.regexp_replace(F.right("before", F.lit(24)), NAMING, "x")
    end = F.concat(F.lit(" "), F.ltrim("after"))
    near = F.concat(F.rtrim(quiet), F.lit(" "))
    names = F.element_at(F.array(*[F.lit(n) for n in ("API_KEY=", "secret_token: ", "AUTH_TOKEN=", "db_password = ", "access_key=")]), (F.pmod(size, F.lit(5)) + 1).cast("int"))
    hashes = F.element_at(F.array(*[F.lit(n) for n in ("commit ", "sha1: ", "md5 ", "revision ", "hash=")]), (F.pmod(size, F.lit(5)) + 1).cast("int"))
    made: dict[str, tuple[Column, Column, Column]] = {
        "aws": (near, F.concat(F.lit("AKIA"), F.left(F.upper("_a"), F.lit(16))), end),
        "github": (near, F.concat(F.lit("ghp_"), alnum(1, 36)), end),
        "slack": (near, F.concat(F.lit("xoxb-"), F.left("_d", F.lit(12)), F.lit("-"), F.substring("_d", 13, 12), F.lit("-"), alnum(1, 24)), end),
        "stripe": (near, F.concat(F.lit("sk_live_"), F.when(size < 12, hexa(32)).otherwise(alnum(1, 24))), end),
        "url": (F.concat(near, F.lit("https://"), word, F.lit(":")), alnum(1, 12 + size), F.concat(F.lit("@"), other, F.lit(".org/"))),
        "jwt": (near, F.concat(F.lit("eyJ"), alnum(1, 33), F.lit(".eyJ"), alnum(34, 30 + size), F.lit("."), alnum(80, 43)), end),
        "pem": (F.concat(F.lit("PRIVATE KEY-----\n"), F.right("_b", F.lit(12)), F.lit("\n")), F.left("_b", F.lit(64)), F.concat(F.lit("\n"), F.substring("_b", 65, 40))),
        "env": (F.concat(near, names), F.when(size < 12, hexa(32)).otherwise(alnum(1, 16 + size)), end),
        "bare": (near, F.when(size < 12, F.left("_b", F.lit(40))).otherwise(alnum(1, 20 + size)), end),
        "quoted": (F.concat(tail, names, F.lit('"')), F.when(size < 12, hexa(40)).otherwise(alnum(1, 20 + size)), F.concat(F.lit('"'), end)),
        "password": (F.concat(tail, F.lit(" password: ")), F.concat(alnum(1, 5), F.lit("$"), alnum(6, 3), F.lit("!"), F.left("_d", F.lit(3))), end),
        "dotted": (near, F.concat(F.lit("SG."), alnum(1, 22), F.lit("."), alnum(23, 43)), end),
        "commit": (F.concat(near, hashes), hexa(40), end),
        "checksum": (F.concat(near, F.lit("sha256:")), hexa(64), end),
        "uuid": (F.concat(near, F.lit("id ")), F.concat_ws("-", hexa(8), F.substring("_x", 9, 4), F.substring("_x", 13, 4), F.substring("_x", 17, 4), F.substring("_x", 21, 12)), end),
        "number": (near, F.left("_d", 16 + size % 8), end),
        "snake": (near, F.concat_ws("_", word, other, F.lit("name"), word), end),
        "path": (near, F.concat_ws("/", F.lit("src"), word, other, F.lit("main")), end),
        "prose": (F.concat(tail, names), F.concat(word, F.lit("-"), other), end),
        "stamp": (near, F.concat(F.lit("2024-"), F.left("_d", F.lit(2)), F.lit("-01T"), F.substring("_d", 3, 6)), end),
    }

    def pick(part: int) -> Column:
        out = F.lit(None).cast("string")
        for form, values in made.items():
            out = F.when(F.col("form") == form, values[part]).otherwise(out)
        return out

    planted = rows.withColumns({"_before": pick(0), "_after": F.left(pick(2), F.lit(CONTEXT)), "_new": pick(1)})
    return planted.select(
        "path", "start", F.col("_new").alias("candidate"), F.right("_before", F.lit(CONTEXT)).alias("before"), F.col("_after").alias("after"),
        F.col("form").isin(*PLANTED_SECRETS).cast("double").alias("secret"),
    )


def train(labelled: DataFrame, most: int = TRAIN_ROWS, more: DataFrame | None = None, trees: int = 32, depth: int = 9) -> RandomForestClassificationModel | None:
    """A forest from ``labelled`` findings (features and ``secret``, 0.0 or 1.0), half of ``most`` rows of each label at most.

    The rows are those with the smallest hash of candidate and neighbourhood; ``more`` are bounded rows that all take part. Without both labels there is no model.
    """
    order = [F.xxhash64("candidate", "before"), "candidate", "before", "start"]
    halves = [labelled.filter(F.col("secret") == v).orderBy(*order).limit(most // 2) for v in (0.0, 1.0)]
    both = halves[0].unionByName(halves[1]).select(*FEATURES, "secret")
    both = both if more is None else both.unionByName(more.select(*FEATURES, "secret"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(both)
    rows = written(rows.select("features", "secret"), "secret-training")
    if rows.select("secret").distinct().count() < 2:
        return None
    return RandomForestClassifier(
        featuresCol="features", labelCol="secret", numTrees=trees, maxDepth=depth, seed=1, featureSubsetStrategy="sqrt"
    ).fit(rows)


def _nodes(docs: DataFrame, path: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    node = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(text).alias("h"))
    return docs.select(node.alias("node"), F.col(path).alias("path"), text.alias("text"))


def judge_candidates(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", most: int = TRAIN_ROWS) -> DataFrame:
    """All candidates of ``docs (doc_id, text, path)`` with ``probability`` and ``is_secret``.

    ``labelled`` has ``candidate, before, after, path, start, secret``. By default those are the real findings that :func:`rule_labels`
    is sure of, and as many planted ones (:func:`planted_findings`); the forest judges all candidates alike. Counts for the dictionary cover all documents.
    """
    keyed = _nodes(docs, path)
    counts = written(word_counts(keyed), "words")
    dictionary = _most_frequent(counts, DICTIONARY_WORDS)
    found = written(candidates(keyed), "places")
    if labelled is None:
        planted = written(planted_findings(found, most), "planted")
        # real and planted candidates in one pass, so that the words of the corpus are joined once
        both = written(with_features(found.unionByName(planted, allowMissingColumns=True), dictionary, counts), "candidates")
        rows = both.filter(F.col("secret").isNull()).drop("secret")
        sure = rows.withColumn("secret", rule_labels()).filter(F.col("secret").isNotNull())
        model = train(sure, most // 2, both.filter(F.col("secret").isNotNull()))
    else:
        rows = written(with_features(found, dictionary, counts), "candidates")
        model = train(with_features(labelled, dictionary, counts), most)
    if model is None:
        scored = rows.withColumn("probability", F.coalesce(rule_labels(), F.lit(0.0)))
    else:
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_f").transform(rows)
        model = model.setFeaturesCol("_f").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
        scored = model.transform(ready).withColumn("probability", vector_to_array("_p")[1])
    return scored.select(*rows.columns, "probability", (F.col("probability") >= 0.5).alias("is_secret"))


def scan_secrets(docs: DataFrame, **settings) -> DataFrame:
    """One row per candidate of ``docs (doc_id, text, source)``: place in the text, hash, probability and verdict.

    Null or empty text has no candidates. Rows that repeat id, text and path are one document here. A null path is an empty one. Very long texts
    are read whole, and texts with very many candidates cost in proportion. An empty table gives no rows; extra columns are ignored. The candidate itself is not returned, only its SHA-256.
    """
    rows = judge_candidates(docs, **settings)
    return rows.select(
        F.nullif(F.col("node.d"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col("start").cast("long"), F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret", F.col("node.h").alias("text_hash"), "place", "path",
    ).dropDuplicates(["doc_id", "text_hash", "place", "path"]).drop("text_hash", "place", "path")


def remove_secrets(docs: DataFrame, mask: str = MASK, **settings) -> DataFrame:
    """``docs`` with every candidate that is judged a secret replaced by ``mask``; all rows, columns and names stay.

    Texts are rebuilt from the same split that found the candidates, so nothing else changes. Null and empty texts stay as they are. Of
    rows that repeat id and text with different paths, all lose what is a secret in one of them. Very long texts and texts with very many
    candidates cost in proportion. An empty table gives no rows; extra columns of any name stay.
    """
    found = judge_candidates(docs, **settings)
    # the verdict on every place of the texts that hold a secret, in order, so that a place's number finds it
    each = found.groupBy("node", "place").agg(F.max("is_secret").alias("s"))
    flags = each.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("_f"), F.max("s").alias("_any"))
    flags = written(flags.filter("_any").select(F.col("node").alias("_node"), F.col("_f.s").alias("_flags")), "secret-places")
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(text).alias("h"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("_key"), "text")

    def rebuilt(s: Column) -> Column:
        masked = lambda c: F.concat(F.left(c, _name_length(c)), F.lit(mask))
        parts = F.transform(s.h, lambda c, i: F.concat(F.get(s.g, i), F.when(F.get("_flags", i), masked(c)).otherwise(c)))
        return F.concat(F.array_join(parts, ""), F.element_at(s.g, -1))

    gaps, hits = _gaps_and_candidates(F.col("text"))
    clean = F.when(F.col("_flags").isNotNull(), let(F.struct(gaps.alias("g"), hits.alias("h")), rebuilt)).otherwise(F.col("text"))
    joined = keyed.join(flags, F.col("_key") == F.col("_node"), "left")
    return joined.select(*[clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
