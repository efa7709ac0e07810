"""Term and accuracy queries over documents, conversations and benchmark texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions.fixed import STOP_WORDS, TOKEN_STRIP
from sonarium.functions.text import clean_text, words
from sonarium.operators.accuracy import mean_accuracy, transcript_accuracy
from sonarium.operators.terms import term_counts, term_summary, term_tokens, top_terms, word_counts
from sonarium.plans.registry import query, rnd, spread, sql_rnd, table

STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

SQL_TOKENS = f"""
tokens AS (
  SELECT doc_id, pos - 1 AS pos, term FROM (
    SELECT doc_id, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos, trim(unnest(ws), '{TOKEN_STRIP}') AS term
    FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws
          FROM documents WHERE text <> ''))
  WHERE length(term) > 2 AND term NOT IN ({STOP_SQL}))"""


@query("terms_tokens", f"WITH {SQL_TOKENS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM tokens")
def terms_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return term_tokens(spread(table(spark, sf, "documents")))


@query(
    "terms_top",
    f"""WITH {SQL_TOKENS},
    counts AS (SELECT term, count(*) AS n, min((doc_id, pos)) AS first_seen FROM tokens GROUP BY term)
    SELECT term, n AS "count", {sql_rnd("100.0 * n / (SELECT count(*) FROM tokens)")} AS percentage
    FROM counts ORDER BY n DESC, first_seen LIMIT 10""",
)
def terms_top(spark: SparkSession, sf: str) -> DataFrame:
    counts = term_counts(term_tokens(spread(table(spark, sf, "documents"))))
    return top_terms(counts).withColumn("percentage", rnd("percentage"))


@query(
    "terms_summary",
    f"""WITH {SQL_TOKENS},
    wc AS (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM documents WHERE text <> '')
    SELECT count(*) AS total_files, (SELECT count(*) FROM tokens) AS total_words,
           (SELECT count(DISTINCT term) FROM tokens) AS unique_words, {sql_rnd("avg(n)")} AS avg_words_per_file
    FROM wc""",
)
def terms_summary(spark: SparkSession, sf: str) -> DataFrame:
    return term_summary(spread(table(spark, sf, "documents"))).withColumn("avg_words_per_file", rnd("avg_words_per_file"))


@query(
    "terms_word_count",
    """SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS word_count
    FROM documents WHERE text <> ''""",
)
def terms_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return word_counts(spread(table(spark, sf, "documents")))


# --- accuracy -----------------------------------------------------------------------------------------------------------

SQL_CLEAN = "trim(regexp_replace(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g'))"


def sql_clean(col: str) -> str:
    return SQL_CLEAN.format(col)


def sql_words(col: str) -> str:
    return f"list_filter(string_split({sql_clean(col)}, ' '), lambda w: w <> '')"


FOREIGN = "0zq0"


def edited(text: Column) -> Column:
    """A deterministic edit of a whole text: every seventh word dropped, every eleventh replaced by a foreign word."""
    numbered = F.transform(words(clean_text(text)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    kept = F.filter(numbered, lambda s: s["i"] % 7 != 6)
    return F.array_join(
        F.transform(kept, lambda s: F.when(s["i"] % 11 == 10, F.lit(FOREIGN)).otherwise(s["w"])), " "
    )


def dropped(text: Column) -> Column:
    """A deterministic edit of a whole text: every fifth word left out."""
    numbered = F.transform(words(clean_text(text)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    return F.array_join(F.transform(F.filter(numbered, lambda s: s["i"] % 5 != 4), lambda s: s["w"]), " ")


@query("accuracy_clean_text", f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents")
def accuracy_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


# The prediction keeps a subsequence of the truth with some words swapped for a word the truth never has. Each foreign word
# costs at least one edit and each missing word another, and the edit itself shows that no more are needed.
@query(
    "accuracy_wer_edited",
    f"""WITH d AS (SELECT doc_id, CAST(len({sql_words('text')}) AS BIGINT) AS n FROM documents),
    e AS (SELECT doc_id, n, n // 7 AS gone, (n + 0) // 11 - n // 77 AS swapped FROM d)
    SELECT doc_id, CAST(n - gone AS INTEGER) AS word_count_predicted, CAST(n AS INTEGER) AS word_count_truth,
           {sql_rnd("CASE WHEN n = 0 THEN 0.0 ELSE least((gone + swapped) / n, 1.0) END")} AS word_error_rate
    FROM e""",
)
def accuracy_wer_edited(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text", edited(F.col("text")).alias("predicted"))
    scored = transcript_accuracy(
        docs, "predicted", "text", ("word_error_rate", "word_count_predicted", "word_count_truth")
    )
    return scored.select(
        "doc_id", "word_count_predicted", "word_count_truth", rnd("word_error_rate").alias("word_error_rate")
    )


# The prediction is a subsequence of the truth's characters, so the distance is the difference in length.
@query(
    "accuracy_cer_dropped",
    f"""WITH d AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
    e AS (SELECT doc_id, array_to_string(w, ' ') AS t,
          array_to_string([x for x, i in w if i % 5 <> 0], ' ') AS p FROM d)
    SELECT doc_id, CAST(length(t) - length(p) AS INTEGER) AS levenshtein_distance,
           {sql_rnd("CASE WHEN t = '' THEN 0.0 ELSE (length(t) - length(p)) / length(t) END")} AS character_error_rate,
           CAST(t = p AS DOUBLE) AS exact_match
    FROM e""",
)
def accuracy_cer_dropped(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text", dropped(F.col("text")).alias("predicted"))
    scored = transcript_accuracy(
        docs, "predicted", "text", ("levenshtein_distance", "character_error_rate", "exact_match")
    )
    return scored.select(
        "doc_id", "levenshtein_distance", rnd("character_error_rate").alias("character_error_rate"), "exact_match"
    )


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as a prediction of the turn before it: pairs of unrelated whole texts."""
    turns = spread(table(spark, sf, "conversations")).select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    return turns.withColumnRenamed("text", "predicted").join(before, ["conv_id", "turn"])


def sql_distance(p: str, t: str) -> str:
    """Edit distance of two lists, row by row of the usual matrix."""
    cells = (
        f"list_reduce(list_transform(range(1, len({t}) + 1), lambda j: [j]), lambda acc, j: list_append(acc, "
        f"least(prev[j[1] + 1] + 1, acc[j[1]] + 1, prev[j[1]] + CASE WHEN {p}[i[1]] = {t}[j[1]] THEN 0 ELSE 1 END)), "
        f"[prev[1] + 1])"
    )
    return (
        f"list_reduce(list_transform(range(1, len({p}) + 1), lambda i: [i]), lambda prev, i: {cells}, "
        f"range(0, len({t}) + 1))[-1]"
    )


SQL_TURNS = f"""pairs AS (
  SELECT a.conv_id, a.turn, {sql_clean('a.text')} AS p, {sql_clean('b.text')} AS t,
         {sql_words('a.text')} AS pw, {sql_words('b.text')} AS tw
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""


@query(
    "accuracy_wer_turns",
    f"""WITH {SQL_TURNS}
    SELECT conv_id, turn, {sql_rnd(f"CASE WHEN len(tw) = 0 THEN CAST(len(pw) > 0 AS DOUBLE) ELSE least({sql_distance('pw', 'tw')} / len(tw), 1.0) END")}
      AS word_error_rate FROM pairs""",
)
def accuracy_wer_turns(spark: SparkSession, sf: str) -> DataFrame:
    scored = transcript_accuracy(turn_pairs(spark, sf), metrics=("word_error_rate",))
    return scored.select("conv_id", "turn", rnd("word_error_rate").alias("word_error_rate"))


# SQL's edit distance counts bytes; the accented letters of the texts are first mapped one to one to upper-case ASCII
# (the texts are lower-case by then), which leaves the number of edits as it is.
ACCENTS = ("ßäçèéêíñóöü", "ABCDEFGHIJK")


@query(
    "accuracy_levenshtein_turns",
    f"""WITH {SQL_TURNS},
    ascii AS (SELECT *, translate(p, '{ACCENTS[0]}', '{ACCENTS[1]}') AS pa,
                     translate(t, '{ACCENTS[0]}', '{ACCENTS[1]}') AS ta FROM pairs)
    SELECT conv_id, turn, CAST(levenshtein(pa, ta) AS INTEGER) AS levenshtein_distance,
           {sql_rnd("CASE WHEN ta = '' THEN CAST(pa <> '' AS DOUBLE) ELSE least(levenshtein(pa, ta) / length(ta), 1.0) END")}
             AS character_error_rate,
           CAST(len(pw) AS INTEGER) AS word_count_predicted, CAST(len(tw) AS INTEGER) AS word_count_truth
    FROM ascii""",
)
def accuracy_levenshtein_turns(spark: SparkSession, sf: str) -> DataFrame:
    scored = transcript_accuracy(
        turn_pairs(spark, sf),
        metrics=("levenshtein_distance", "character_error_rate", "word_count_predicted", "word_count_truth"),
    )
    return scored.select(
        "conv_id",
        "turn",
        "levenshtein_distance",
        rnd("character_error_rate").alias("character_error_rate"),
        "word_count_predicted",
        "word_count_truth",
    )


# difflib has no SQL form, so these two are checked in pytest
@query("accuracy_similarity")
def accuracy_similarity(spark: SparkSession, sf: str) -> DataFrame:
    scored = transcript_accuracy(turn_pairs(spark, sf), metrics=("accuracy_percentage", "character_similarity"))
    return scored.select(
        "conv_id",
        "turn",
        rnd("accuracy_percentage").alias("accuracy_percentage"),
        rnd("character_similarity").alias("character_similarity"),
    )


# The truth table covers few of the documents, as the optional ground truth of a dataset does.
@query(
    "accuracy_no_truth",
    f"""SELECT d.doc_id,
      CASE WHEN b.text IS NULL OR b.text = '' THEN NULL ELSE CAST({sql_clean('d.text')} = {sql_clean('b.text')} AS DOUBLE) END AS exact_match,
      CAST(CASE WHEN b.text IS NULL OR b.text = ''
           THEN len(list_filter(string_split_regex(d.text, '\\s+'), lambda w: w <> ''))
           ELSE len({sql_words('d.text')}) END AS INTEGER) AS word_count_predicted,
      CAST(CASE WHEN b.text IS NULL OR b.text = '' THEN 0 ELSE len({sql_words('b.text')}) END AS INTEGER) AS word_count_truth
    FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id""",
)
def accuracy_no_truth(spark: SparkSession, sf: str) -> DataFrame:
    truth = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("truth"))
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.col("text").alias("predicted"))
    return transcript_accuracy(
        docs.join(truth, "doc_id", "left"), metrics=("exact_match", "word_count_predicted", "word_count_truth")
    ).drop("predicted", "truth")


@query(
    "accuracy_mean_by_lang",
    f"""WITH d AS (SELECT lang, CAST(len({sql_words('text')}) AS BIGINT) AS n FROM documents),
    e AS (SELECT lang, CASE WHEN n = 0 THEN 0.0 ELSE least((n // 7 + n // 11 - n // 77) / n, 1.0) END AS wer FROM d)
    SELECT lang, count(*) AS files, {sql_rnd("avg(wer)")} AS avg_word_error_rate FROM e GROUP BY lang""",
)
def accuracy_mean_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents")).select("lang", "text", edited(F.col("text")).alias("predicted"))
    scored = transcript_accuracy(docs, "predicted", "text", ("word_error_rate",))
    means = mean_accuracy(scored, ["lang"], ["word_error_rate"])
    return means.withColumn("avg_word_error_rate", rnd("avg_word_error_rate"))
