"""Label, result-table, feature-profile and embedding queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sonarium.functions import rows as R
from sonarium.functions.fixed import TTL_BY_KIND
from sonarium.operators import embed as E
from sonarium.operators import labels as B
from sonarium.operators import lookup as L
from sonarium.operators import profile as P
from sonarium.operators import results as M
from sonarium.operators import selections as S
from sonarium.operators.terms import term_counts, term_tokens, top_terms
from sonarium.plans.registry import query, rnd, sql_rnd, table
from sonarium.plans.text import SQL_TOKENS
from sonarium.session import settle, shared_dir
from sonarium.sources.results import ResultLog

# --- labels -------------------------------------------------------------------------------------------------------------

ID2LABEL = ("angry", "calm", "fear", "happy")
NAMES_SQL = "['angry', 'calm', 'fear', 'happy']"

SOFTMAX_SQL = f"""
e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
best AS (SELECT vec_id, p, list_position(p, list_max(p)) AS b FROM p)"""


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Whole embeddings as logits; labels beyond the named ones are called by their index."""
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("logits"))


@query(
    "labels_softmax",
    f"""WITH {SOFTMAX_SQL} SELECT vec_id, coalesce({NAMES_SQL}[b], CAST(b - 1 AS VARCHAR)) AS predicted_label,
      {sql_rnd("p[b]", 9)} AS confidence, {sql_rnd("p[1]", 9)} AS angry, {sql_rnd("p[5]", 9)} AS emotion_4 FROM best""",
)
def labels_softmax(spark: SparkSession, sf: str) -> DataFrame:
    predicted = B.predict_labels(logits(spark, sf), "logits", ID2LABEL)
    return predicted.select(
        "vec_id",
        "predicted_label",
        rnd("confidence", 9).alias("confidence"),
        rnd(F.col("probabilities")["angry"], 9).alias("angry"),
        rnd(F.col("probabilities")["emotion_4"], 9).alias("emotion_4"),
    )


@query(
    "labels_ranked",
    f"""WITH {SOFTMAX_SQL}, l AS (SELECT vec_id, b, i, coalesce({NAMES_SQL}[i], 'emotion_' || CAST(i - 1 AS VARCHAR)) AS label, p[i] AS probability
      FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM best))
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY probability DESC, label) AS INTEGER) AS rank, label,
      {sql_rnd("probability", 9)} AS probability, label = coalesce({NAMES_SQL}[b], CAST(b - 1 AS VARCHAR)) AS is_predicted FROM l""",
)
def labels_ranked(spark: SparkSession, sf: str) -> DataFrame:
    ranked = B.ranked_probabilities(B.predict_labels(logits(spark, sf), "logits", ID2LABEL))
    return ranked.select("vec_id", "rank", "label", rnd("probability", 9).alias("probability"), "is_predicted")


# A failing file: documents without an embedding have no logits.
@query(
    "labels_fallback",
    f"""WITH {SOFTMAX_SQL} SELECT d.doc_id, coalesce({NAMES_SQL}[b], CAST(b - 1 AS VARCHAR), 'unknown') AS predicted_label,
      coalesce({sql_rnd("p[b]", 9)}, 0.0) AS confidence, b IS NULL AS fallback FROM documents d LEFT JOIN best ON doc_id = vec_id""",
)
def labels_fallback(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select("doc_id")
    joined = files.join(logits(spark, sf).withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return B.predict_labels(joined, "logits", ID2LABEL).select(
        "doc_id", "predicted_label", rnd("confidence", 9).alias("confidence"), "fallback"
    )


def picky_scorer():
    """A model that doubles a vector and refuses those that begin below zero, by their first value."""

    def predict(vectors: np.ndarray) -> list:
        for v in vectors:
            if v[0] < 0:
                raise ValueError(f"first value is {round(float(v[0]) * 1000)} thousandths")
        return [2.0 * np.asarray(v, dtype=np.float64) for v in vectors]

    return predict


@query(
    "labels_scorer_errors",
    f"""WITH l AS (SELECT vec_id, embedding[1] < 0 AS bad, 'first value is ' || CAST(CAST(round_even(CAST(embedding[1] AS DOUBLE) * 1000, 0) AS BIGINT) AS VARCHAR) || ' thousandths' AS told,
      list_transform(embedding, lambda x: 2 * CAST(x AS DOUBLE)) AS l FROM embeddings),
    e AS (SELECT *, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM l), p AS (SELECT *, list_position(e, list_max(e)) AS b FROM e)
    SELECT vec_id, CASE WHEN bad THEN 'unknown' ELSE coalesce({NAMES_SQL}[b], CAST(b - 1 AS VARCHAR)) END AS predicted_label,
      CASE WHEN bad THEN 0.0 ELSE {sql_rnd("e[b] / list_sum(e)", 9)} END AS confidence, bad AS fallback, CASE WHEN bad THEN told END AS error FROM p""",
)
def labels_scorer_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = M.score_or_error(rows, picky_scorer, ["embedding"], "logits", ArrayType(DoubleType()), "told")
    return B.predict_labels(scored, "logits", ID2LABEL, "told").select(
        "vec_id", "predicted_label", rnd("confidence", 9).alias("confidence"), "fallback", "error"
    )


@query(
    "labels_distribution",
    f"""SELECT event_type AS label, count(*) AS "count", {sql_rnd("count(*) / (SELECT count(*) FROM events)")} AS share FROM events GROUP BY 1""",
)
def labels_distribution(spark: SparkSession, sf: str) -> DataFrame:
    counts = B.label_counts(table(spark, sf, "events"), "event_type", "event_id")
    return B.label_distribution(counts).withColumn("share", rnd("share"))


@query(
    "labels_dominant",
    f"""SELECT event_type AS label, count(*) AS "count", {sql_rnd("count(*) / (SELECT count(*) FROM events)")} AS share FROM events
    GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 1""",
)
def labels_dominant(spark: SparkSession, sf: str) -> DataFrame:
    counts = B.label_counts(table(spark, sf, "events"), "event_type", "event_id")
    return B.dominant_label(counts).withColumn("share", rnd("share"))


@query(
    "labels_hit_counters",
    f"""SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses,
      {sql_rnd("count(*) FILTER (event_type = 'view') / count(*)")} AS hit_rate FROM events""",
)
def labels_hit_counters(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "events").select((F.col("event_type") == "view").alias("hit"))
    return B.hit_counters(seen, "hit").withColumn("hit_rate", rnd("hit_rate"))


# --- result table -------------------------------------------------------------------------------------------------------


@query(
    "results_key",
    """SELECT page_id, 'whisper_' || md5(url) AS plain, 'whisper_attention_pairs_' || md5(url) || '_l6_h0' AS pairs,
      'wav2vec2_saliency_' || md5(url || '_' || CAST(length(html) AS VARCHAR) || '_' || CAST(page_id AS VARCHAR)) || '_v2' AS versioned FROM pages""",
)
def results_key(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        R.result_key(F.lit("whisper"), url).alias("plain"),
        R.result_key(F.lit("whisper"), url, "attention_pairs", layer=6, head=0).alias("pairs"),
        R.result_key(
            F.lit("wav2vec2"), url, "saliency", size=F.length("html"), mtime=F.col("page_id"), version="v2"
        ).alias("versioned"),
    )


def puts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as writes to the result table: key = user, model = event type."""
    kinds = F.array(*[F.lit(k) for k in TTL_BY_KIND])
    return table(spark, sf, "events").select(
        F.col("event_type").alias("model"),
        F.col("user_id").alias("key"),
        F.col("ts").alias("written_at"),
        F.col("event_id").alias("seq"),
        F.col("props").alias("payload"),
        M.ttl_seconds(F.get(kinds, (F.col("event_id") % len(TTL_BY_KIND)).cast("int"))).alias("ttl_s"),
    )


TTL_SQL = "[" + ", ".join(str(v) for v in TTL_BY_KIND.values()) + f"][event_id % {len(TTL_BY_KIND)} + 1]"
PUTS_SQL = f"""puts AS (SELECT event_type AS model, user_id AS "key", ts AS written_at, event_id AS seq, props AS payload, CAST({TTL_SQL} AS INTEGER) AS ttl_s FROM events),
latest AS (SELECT * FROM puts QUALIFY row_number() OVER (PARTITION BY model, "key" ORDER BY written_at DESC, seq DESC) = 1)"""


@query("results_latest", f'WITH {PUTS_SQL} SELECT model, "key", seq, payload, ttl_s FROM latest')
def results_latest(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest_results(puts(spark, sf)).select("model", "key", "seq", "payload", "ttl_s")


NOW = "2024-01-16 00:00:00"


@query(
    "results_visible",
    f"""WITH {PUTS_SQL.replace("FROM events)", f"FROM events WHERE ts <= TIMESTAMP '{NOW}')")}
    SELECT model, "key", seq, payload FROM latest WHERE TIMESTAMP '{NOW}' < written_at + to_seconds(ttl_s)""",
)
def results_visible(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp_ntz")
    written = puts(spark, sf).filter(F.col("written_at") <= now)
    return M.visible_results(written, now).select("model", "key", "seq", "payload")


def appended(spark: SparkSession, rows: DataFrame, part_keys: int, writes: int = 4) -> ResultLog:
    """``rows`` written to a new log in several appends, one of them before, the others around two compactions."""
    log = ResultLog(spark, shared_dir(spark, "log"), part_keys)
    dealt = rows.withColumn("_w", F.pmod(F.xxhash64("seq"), F.lit(writes)))
    for w in range(writes):
        log.append(dealt.filter(F.col("_w") == w))
        if w in (1, 2):
            log.compact()
    return log


@query("results_compacted", f'WITH {PUTS_SQL} SELECT model, CAST("key" AS VARCHAR) AS "key", seq, payload, ttl_s FROM latest')
def results_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Last write per key from a log of many appends and two snapshots."""
    rows = puts(spark, sf).withColumns({"key": F.col("key").cast("string"), "written_at": F.col("written_at").cast("timestamp")})
    return M.latest_results(appended(spark, rows, 500).log()).select("model", "key", "seq", "payload", "ttl_s")


@query(
    "lookup_logged",
    """SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS payload, l.doc_id IS NOT NULL AS cached FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def lookup_logged(spark: SparkSession, sf: str) -> DataFrame:
    """Every document looked up in a compacted log, of which only the parts are read whose filters hit."""
    rows = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("string").alias("payload"), F.col("doc_id").alias("seq"),
        F.lit(NOW).cast("timestamp").alias("written_at"), F.lit(60).alias("ttl_s"), F.lit("quality").alias("model"),
    )
    wanted = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    held = appended(spark, rows, 300).get("quality", F.lit(NOW), wanted).select("key", "payload")
    return L.batch_check(wanted, held, "key").select("doc_id", "payload", "cached")


@query(
    "results_ttl",
    f"""SELECT CAST({TTL_SQL} AS INTEGER) AS ttl_s, count(*) AS n FROM events GROUP BY 1""",
)
def results_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return puts(spark, sf).groupBy("ttl_s").agg(F.count(F.lit(1)).alias("n"))


@query(
    "results_heavy_column",
    """SELECT (event_type = 'view') AS wanted, count(*) AS usable FROM events WHERE event_type <> 'view' OR event_id % 2 = 1 GROUP BY 1""",
)
def results_heavy_column(spark: SparkSession, sf: str) -> DataFrame:
    """Rows stored with the column stripped (even ids) are misses only where the column is asked for (views)."""
    rows = table(spark, sf, "events").select("event_id", (F.col("event_type") == "view").alias("wanted"), "props")
    stripped = M.strip_heavy_column(rows.filter("event_id % 2 = 0"), "props")
    stored = rows.filter("event_id % 2 = 1").unionByName(stripped)
    usable = M.usable_results(stored.filter("wanted"), "props", True).unionByName(
        M.usable_results(stored.filter("NOT wanted"), "props", False)
    )
    return usable.groupBy("wanted").agg(F.count(F.lit(1)).alias("usable"))


def make_linear_model():
    """A stand-in model: weights 1/1, 1/2, … over the embedding."""
    weights = 1.0 / np.arange(1, 65)

    def predict(vectors: np.ndarray) -> np.ndarray:
        return vectors.astype("float64") @ weights

    return predict


@query(
    "results_score_missing",
    f"""SELECT e.vec_id, {sql_rnd("CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) / i)) END")} AS score,
      l.doc_id IS NOT NULL AS from_cache FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id""",
)
def results_score_missing(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "embeddings").select("vec_id", "embedding")
    held = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").cast("double").alias("score"))
    scored = M.score_missing(
        files, held, "vec_id", make_linear_model, ["embedding"], "score", DoubleType(), input_shapes=[[64]]
    )
    return scored.withColumn("score", rnd("score"))


@query(
    "results_progress",
    f"""WITH s AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'idle' WHEN l.toxic = 1 THEN 'error' ELSE 'done' END AS status
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT status, count(*) AS files, {sql_rnd("count(*) / (SELECT count(*) FROM s)")} AS share FROM s GROUP BY 1""",
)
def results_progress(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    out = M.progress(docs, table(spark, sf, "labels"), "doc_id", F.col("toxic") == 1)
    return out.withColumn("share", rnd("share"))


# --- feature profile ----------------------------------------------------------------------------------------------------

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
MELT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM lineitem" for c in FEATURES)


def long_features(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", *FEATURES)
    return P.melt(items, "l_orderkey", FEATURES)


@query(
    "profile_flatten",
    """SELECT l_orderkey, l_linenumber, l_quantity AS rms_mean, l_tax AS rms_std, l_discount AS mfcc_mfcc_1_mean, l_extendedprice AS duration FROM lineitem""",
)
def profile_flatten(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.struct(
            F.struct(F.col("l_quantity").alias("mean"), F.col("l_tax").alias("std")).alias("rms"),
            F.struct(F.col("l_discount").alias("mfcc_1_mean")).alias("mfcc"),
            F.col("l_extendedprice").alias("duration"),
        ).alias("features"),
    )
    return P.flatten_features(items, "features")


@query(
    "profile_melt",
    f"""SELECT feature, count(*) AS n, {sql_rnd('sum(value)', 2)} AS total FROM (
      SELECT 'l_quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem WHERE l_tax > 0) GROUP BY 1""",
)
def profile_melt(spark: SparkSession, sf: str) -> DataFrame:
    """Union of keys over files: a file without tax has no such key."""
    features = P.as_feature_map({"l_quantity": F.col("l_quantity"), "l_tax": F.when(F.col("l_tax") > 0, F.col("l_tax"))})
    items = table(spark, sf, "lineitem").select("l_orderkey", features.alias("features"))
    long = P.melt(items, "l_orderkey", "features")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 2).alias("total"))


STATS_SQL = f"""long AS ({MELT_SQL}), stats AS (SELECT feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.5) AS median FROM long GROUP BY feature)"""


@query(
    "profile_stats",
    f"""WITH {STATS_SQL} SELECT feature, n, {sql_rnd('mean')} AS mean, {sql_rnd('std')} AS std, min, max, {sql_rnd('median')} AS median FROM stats""",
)
def profile_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = P.feature_stats(long_features(spark, sf))
    return stats.withColumns({c: rnd(c) for c in ("mean", "std", "median")})


@query(
    "profile_histogram",
    f"""WITH long AS ({MELT_SQL}), r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1),
    n AS (SELECT feature, value, lo, hi, CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS k FROM long JOIN r USING (feature)),
    b AS (SELECT feature, CASE WHEN k > 0 AND value < lo + k * ((hi - lo) / 10) THEN k - 1 WHEN k < 9 AND value >= lo + (k + 1) * ((hi - lo) / 10) THEN k + 1 ELSE k END AS bin, count(*) AS c FROM n GROUP BY ALL)
    SELECT r.feature, CAST(g.bin AS INTEGER) AS bin, {sql_rnd('lo + g.bin * ((hi - lo) / 10)')} AS left_edge,
      {sql_rnd('CASE WHEN g.bin = 9 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / 10) END')} AS right_edge, coalesce(c, 0) AS "count"
    FROM r CROSS JOIN range(10) g(bin) LEFT JOIN b ON b.feature = r.feature AND b.bin = g.bin""",
)
def profile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    bins = P.histogram(long_features(spark, sf))
    return bins.withColumns({"left_edge": rnd("left_edge"), "right_edge": rnd("right_edge")})


@query(
    "profile_prevalence",
    f"""WITH {STATS_SQL}, s AS (SELECT *, (mean - min) / (max - min) AS nm, CASE WHEN mean = 0 THEN 1.0 ELSE 1.0 / (1.0 + std / abs(mean)) END AS st FROM stats WHERE max > min)
    SELECT feature, {sql_rnd('nm')} AS normalized_mean, {sql_rnd('st')} AS stability_score, {sql_rnd('nm * st')} AS prevalence_score,
      {sql_rnd('mean')} AS mean, {sql_rnd('std')} AS std FROM s ORDER BY nm * st DESC, feature LIMIT 10""",
)
def profile_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    ranked = P.prevalence_rank(P.feature_stats(long_features(spark, sf), median=False))
    numbers = [c for c in ranked.columns if c != "feature"]
    return ranked.withColumns({c: rnd(c) for c in numbers})


CATEGORY_NAMES = ("spectral_centroid", "zero_crossing_rate_mean", "rms_energy", "mfcc_1", "chroma_2", "tonnetz_3", "tempo", "sample_rate", "spectral_energy")


@query(
    "profile_categories",
    f"""WITH f AS (SELECT DISTINCT [{", ".join(f"'{n}'" for n in CATEGORY_NAMES)}][event_id % {len(CATEGORY_NAMES)} + 1] AS feature FROM events)
    SELECT 'spectral' AS category, feature FROM f WHERE starts_with(feature, 'spectral_') OR starts_with(feature, 'zero_crossing')
    UNION ALL SELECT 'energy', feature FROM f WHERE contains(feature, 'rms') OR contains(feature, 'energy')
    UNION ALL SELECT 'mfcc', feature FROM f WHERE starts_with(feature, 'mfcc_') UNION ALL SELECT 'chroma', feature FROM f WHERE starts_with(feature, 'chroma_')
    UNION ALL SELECT 'tonnetz', feature FROM f WHERE starts_with(feature, 'tonnetz_') UNION ALL SELECT 'temporal', feature FROM f WHERE feature IN ('tempo', 'duration')
    UNION ALL SELECT 'metadata', feature FROM f WHERE feature = 'sample_rate'""",
)
def profile_categories(spark: SparkSession, sf: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(n) for n in CATEGORY_NAMES]), (F.col("event_id") % len(CATEGORY_NAMES)).cast("int"))
    return P.categorise(table(spark, sf, "events").select(name.alias("feature")))


@query(
    "profile_summary",
    f"""SELECT count(DISTINCT l_orderkey) AS total_files, CAST(2 AS BIGINT) AS total_features_extracted, {sql_rnd('avg(l_quantity)')} AS avg_duration, CAST(0 AS DOUBLE) AS avg_tempo FROM lineitem""",
)
def profile_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("duration"), "l_tax")
    out = P.profile_summary(P.melt(items, "l_orderkey", ["duration", "l_tax"]), "l_orderkey")
    return out.withColumns({"avg_duration": rnd("avg_duration"), "avg_tempo": rnd("avg_tempo")})


# --- embedding space ----------------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The plot of all embeddings: the first three principal coordinates of the whole vectors."""
    reduced = E.pca(table(spark, sf, "embeddings"), "vec_id", "embedding", 3)
    return reduced.select("vec_id", *[F.get("coordinates", F.lit(k)).alias(a) for k, a in enumerate("xyz")])


def _axis_sql(k: int) -> str:
    """The strongest axis of covariance ``c{k}``: repeated squaring leaves one direction, whose share is then taken out."""
    return f"""s{k} AS (SELECT 0 AS step, m FROM c{k} UNION ALL SELECT step + 1, list_transform(u, lambda r: list_transform(u, lambda c: list_inner_product(r, c)))
      FROM (SELECT step, list_transform(m, lambda r: list_transform(r, lambda x: x / list_sum(list_transform(m, lambda q, i: q[i])))) AS u FROM s{k} WHERE step < 20)),
    w{k} AS (SELECT m[list_position(list_transform(m, lambda q, i: q[i]), list_max(list_transform(m, lambda q, i: q[i])))] AS v FROM s{k} WHERE step = 20),
    n{k} AS (SELECT list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM w{k}),
    a{k} AS (SELECT list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) AS v FROM n{k}),
    e{k} AS (SELECT v, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS e FROM a{k}, c{k}),
    c{k + 1} AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - e * v[i] * v[j])) AS m FROM c{k}, e{k})"""


POINTS_SQL = f"""pts AS MATERIALIZED (WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    dims AS (SELECT d, avg(x) AS mean FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM x) GROUP BY d),
    mean AS (SELECT list(mean ORDER BY d) AS mu FROM dims),
    z AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x, i: x - mu[i]) AS v FROM x, mean),
    cols AS (SELECT d, list(x ORDER BY vec_id) AS col FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM z) GROUP BY d),
    cells AS (SELECT a.d AS i, list(list_inner_product(a.col, b.col) / len(a.col) ORDER BY b.d) AS r FROM cols a, cols b GROUP BY a.d),
    c1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM cells), {_axis_sql(1)}, {_axis_sql(2)}, {_axis_sql(3)}
    SELECT vec_id, list_inner_product(z.v, a1.v) AS x, list_inner_product(z.v, a2.v) AS y, list_inner_product(z.v, a3.v) AS z FROM z, a1, a2, a3)"""


@query(
    "embed_mean_pool",
    f"""SELECT label, d - 1 AS dim, {sql_rnd('avg(x)', 9)} AS value FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS d FROM embeddings) GROUP BY ALL""",
)
def embed_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = E.mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", rnd("value", 9))


@query(
    "embed_rows",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value
    FROM embeddings WHERE len(embedding) > 0""",
)
def embed_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.embedding_rows(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return rows.select("vec_id", "dimension", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query("embed_pca", f"WITH {POINTS_SQL} SELECT vec_id, {', '.join(f'{sql_rnd(a, 9)} AS {a}' for a in 'xyz')} FROM pts")
def embed_pca(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select("vec_id", *[rnd(a, 9).alias(a) for a in "xyz"])


@query(
    "embed_regions",
    f"""WITH {POINTS_SQL}, q AS (SELECT list_sort(list(x))[CAST(floor(count(*) * 0.25) AS BIGINT) + 1] AS x1, list_sort(list(x))[CAST(floor(count(*) * 0.75) AS BIGINT) + 1] AS x3,
       list_sort(list(y))[CAST(floor(count(*) * 0.25) AS BIGINT) + 1] AS y1, list_sort(list(y))[CAST(floor(count(*) * 0.75) AS BIGINT) + 1] AS y3 FROM pts)
    SELECT vec_id, CASE WHEN x > x3 AND y > y3 THEN 'region1' WHEN x < x1 AND y > y3 THEN 'region2' WHEN x < x1 AND y < y1 THEN 'region3' WHEN x > x3 AND y < y1 THEN 'region4'
      WHEN x BETWEEN x1 AND x3 AND y BETWEEN y1 AND y3 THEN 'center' WHEN x BETWEEN x1 AND x3 THEN 'mid_vertical' WHEN y BETWEEN y1 AND y3 THEN 'mid_horizontal' ELSE 'unknown' END AS region
    FROM pts, q""",
)
def embed_regions(spark: SparkSession, sf: str) -> DataFrame:
    return E.spatial_regions(points(spark, sf), "x", "y").select("vec_id", "region")


ANGLE_SQL = "CASE WHEN x = 0 AND y = 0 AND z = 0 THEN 0.0 ELSE 90 - degrees(acos(abs({0}) / sqrt(x * x + y * y + z * z))) END"


@query(
    "embed_angles",
    f"""WITH {POINTS_SQL} SELECT vec_id, {sql_rnd(ANGLE_SQL.format('z'))} AS xy, {sql_rnd(ANGLE_SQL.format('y'))} AS xz, {sql_rnd(ANGLE_SQL.format('x'))} AS yz FROM pts""",
)
def embed_angles(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return points(spark, sf).select("vec_id", *[rnd(E.angle_to_plane(x, y, z, p)).alias(p) for p in ("xy", "xz", "yz")])


@query(
    "embed_select_angle",
    f"""WITH {POINTS_SQL} SELECT vec_id, {sql_rnd(ANGLE_SQL.format('z'))} AS angle FROM pts WHERE {ANGLE_SQL.format('z')} BETWEEN 40 AND 50""",
)
def embed_select_angle(spark: SparkSession, sf: str) -> DataFrame:
    coords = points(spark, sf).select("vec_id", F.array("x", "y", "z").alias("coordinates"))
    return E.select_by_angle(coords, "coordinates", "xy").select("vec_id", rnd("angle").alias("angle"))


@query(
    "embed_select_box",
    f"WITH {POINTS_SQL} SELECT vec_id FROM pts WHERE x BETWEEN -0.1 AND 0.05 AND y BETWEEN 0.0 AND 0.2",
)
def embed_select_box(spark: SparkSession, sf: str) -> DataFrame:
    return E.select_box(points(spark, sf), "x", "y", (-0.1, 0.05), (0.0, 0.2)).select("vec_id")


# inside a triangle = on one side of all three edges
@query(
    "embed_select_lasso",
    f"""WITH {POINTS_SQL}, s AS (SELECT vec_id, (0.2 - -0.2) * (y - -0.15) - (-0.1 - -0.15) * (x - -0.2) AS a, (0.0 - 0.2) * (y - -0.1) - (0.25 - -0.1) * (x - 0.2) AS b,
      (-0.2 - 0.0) * (y - 0.25) - (-0.15 - 0.25) * (x - 0.0) AS c FROM pts) SELECT vec_id FROM s WHERE a > 0 AND b > 0 AND c > 0""",
)
def embed_select_lasso(spark: SparkSession, sf: str) -> DataFrame:
    triangle = [(-0.2, -0.15), (0.2, -0.1), (0.0, 0.25)]
    return E.select_lasso(points(spark, sf), "x", "y", triangle).select("vec_id")


@query(
    "embed_axis_bounds",
    f"WITH {POINTS_SQL} SELECT "
    + ", ".join(f"{sql_rnd(f'min({a}) * 1.1', 9)} AS {a}_low, {sql_rnd(f'max({a}) * 1.1', 9)} AS {a}_high" for a in "xyz")
    + " FROM pts",
)
def embed_axis_bounds(spark: SparkSession, sf: str) -> DataFrame:
    bounds = E.axis_bounds(points(spark, sf), ["x", "y", "z"])
    return bounds.select(*[rnd(c, 9).alias(c) for c in bounds.columns])


# Shapes around the plotted points themselves: an L of six corners for every fifth point, a box for the point after it.
CORNERS = ((-0.5, -0.6), (1.5, -0.6), (1.5, 0.4), (0.5, 0.4), (0.0, 1.4), (-0.5, 1.4))

SHAPES_SQL = f"""sh AS (SELECT vec_id AS selection, x AS mx, y AS my, 0.02::DOUBLE * (1 + vec_id % 7) AS r, vec_id % 5 = 1 AS is_box FROM pts WHERE vec_id % 5 < 2),
ring AS (SELECT *, [{", ".join(f"{{'x': mx + {x}::DOUBLE * r, 'y': my + {y}::DOUBLE * r}}" for x, y in CORNERS)}] AS ring FROM sh),
edge AS (SELECT *, list_transform(ring, lambda p, i: {{'x0': p.x, 'y0': p.y, 'x1': ring[i % 6 + 1].x, 'y1': ring[i % 6 + 1].y}}) AS e FROM ring),
hit AS (SELECT selection, vec_id FROM edge JOIN pts ON CASE WHEN is_box THEN x BETWEEN mx - r AND mx + r AND y BETWEEN my - 2 * r AND my + 2 * r
  ELSE len(list_filter(e, lambda d: (d.y0 > y) <> (d.y1 > y) AND x < d.x0 + (y - d.y0) * ((d.x1 - d.x0) / (d.y1 - d.y0)))) % 2 = 1 END)"""


def shapes(plotted: DataFrame) -> DataFrame:
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    sized = plotted.filter("vec_id % 5 < 2").withColumn("r", 0.02 * (1 + F.col("vec_id") % 7))
    outline = F.array(*[F.struct((x + a * r).alias("x"), (y + b * r).alias("y")) for a, b in CORNERS])
    boxed = F.col("vec_id") % 5 == 1
    ring = F.when(boxed, S.box_ring(x - r, y - 2 * r, x + r, y + 2 * r)).otherwise(outline)
    return sized.select(F.col("vec_id").alias("selection"), ring.alias("ring"), boxed.alias("is_box"))


@query("embed_select_many", f"WITH {POINTS_SQL}, {SHAPES_SQL} SELECT selection, vec_id FROM hit")
def embed_select_many(spark: SparkSession, sf: str) -> DataFrame:
    plotted = settle(points(spark, sf))
    return S.select_many(plotted, shapes(plotted), "vec_id", "x", "y")


@query(
    "embed_many_labels",
    f"""WITH {POINTS_SQL}, {SHAPES_SQL}, c AS (SELECT selection, label, count(*) AS n FROM hit JOIN embeddings USING (vec_id) GROUP BY ALL)
    SELECT selection, label, n AS "count", {sql_rnd("n / sum(n) OVER (PARTITION BY selection)")} AS share FROM c""",
)
def embed_many_labels(spark: SparkSession, sf: str) -> DataFrame:
    plotted = settle(points(spark, sf))
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    return S.count_groups(plotted, shapes(plotted), labels, "vec_id", "x", "y", "label").withColumn("share", rnd("share"))


BOX_SQL = "SELECT vec_id FROM pts WHERE x BETWEEN -0.1 AND 0.05 AND y BETWEEN 0.0 AND 0.2"


@query(
    "embed_selection_terms",
    f"""WITH {POINTS_SQL}, {SQL_TOKENS}, kept AS (SELECT * FROM tokens WHERE doc_id IN ({BOX_SQL})),
    counts AS (SELECT term, count(*) AS n, min((doc_id, pos)) AS first_seen FROM kept GROUP BY term)
    SELECT term, n AS "count", {sql_rnd("100.0 * n / (SELECT count(*) FROM kept)")} AS percentage FROM counts ORDER BY n DESC, first_seen LIMIT 10""",
)
def embed_selection_terms(spark: SparkSession, sf: str) -> DataFrame:
    chosen = embed_select_box(spark, sf).withColumnRenamed("vec_id", "doc_id")
    cohort = E.restrict_to(table(spark, sf, "documents").select("doc_id", "text"), chosen, "doc_id")
    return top_terms(term_counts(term_tokens(cohort))).withColumn("percentage", rnd("percentage"))


@query(
    "embed_selection_labels",
    f"""WITH {POINTS_SQL}, s AS (SELECT label FROM embeddings WHERE vec_id IN ({BOX_SQL}))
    SELECT label, count(*) AS "count", {sql_rnd("count(*) / (SELECT count(*) FROM s)")} AS share FROM s GROUP BY label""",
)
def embed_selection_labels(spark: SparkSession, sf: str) -> DataFrame:
    chosen = embed_select_box(spark, sf)
    cohort = E.restrict_to(table(spark, sf, "embeddings").select("vec_id", "label"), chosen, "vec_id")
    return B.label_distribution(B.label_counts(cohort, "label", "vec_id")).withColumn("share", rnd("share"))


@query(
    "embed_selection_features",
    f"""WITH {POINTS_SQL}, {STATS_SQL.replace("FROM lineitem", f"FROM lineitem WHERE l_orderkey IN ({BOX_SQL})")}
    SELECT feature, n, {sql_rnd('mean')} AS mean, {sql_rnd('std')} AS std, min, max, {sql_rnd('median')} AS median FROM stats""",
)
def embed_selection_features(spark: SparkSession, sf: str) -> DataFrame:
    chosen = embed_select_box(spark, sf).withColumnRenamed("vec_id", "l_orderkey")
    items = E.restrict_to(table(spark, sf, "lineitem").select("l_orderkey", *FEATURES), chosen, "l_orderkey")
    stats = P.feature_stats(P.melt(items, "l_orderkey", FEATURES))
    return stats.withColumns({c: rnd(c) for c in ("mean", "std", "median")})
