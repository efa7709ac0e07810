"""Catalog, row and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions import rows as R
from sonarium.functions.fixed import (
    FEATURE_CLASS_TEXTS,
    FEATURE_DEFAULT_TEXT,
    FEATURE_TEXTS,
    MEDIA_TYPES,
    NAME_LABELS,
    ORDINALS,
)
from sonarium.operators import catalog as C
from sonarium.operators import lookup as L
from sonarium.plans.registry import query, rnd, sql_rnd, table

# Files of a dataset, as the documents table gives them: source = dataset, lang = uploaded name, n_chars = size.
EXTENSIONS = (".wav", ".MP3", ".m4a", ".flac", ".txt", "")
EXT_SQL = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query(
    "catalog_default_duration",
    """SELECT d.doc_id, coalesce(CAST(round(CAST(l.quality * 1.234567 + d.doc_id % 7 AS DOUBLE), 2) AS VARCHAR), '0.0') AS duration
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def catalog_default_duration(spark: SparkSession, sf: str) -> DataFrame:
    clips = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") * F.lit(1.234567) + F.col("doc_id") % 7).alias("duration")
    )
    return C.with_default_duration(documents(spark, sf).select("doc_id"), clips, "doc_id")


@query(
    "catalog_media_type",
    f"""SELECT * FROM (SELECT doc_id, path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1))
        {" ".join(f"WHEN '{e}' THEN '{m}'" for e, m in MEDIA_TYPES.items())} END AS media_type
      FROM (SELECT doc_id, source || '/' || lang || CAST(doc_id AS VARCHAR) || {EXT_SQL}[doc_id % 6 + 1] AS path FROM documents))
    WHERE media_type IS NOT NULL""",
)
def catalog_media_type(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % 6).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.col("doc_id").cast("string"), ext)
    files = documents(spark, sf).select("doc_id", path.alias("path"))
    return files.withColumn("media_type", R.media_type(F.col("path"))).filter(F.col("media_type").isNotNull())


@query(
    "catalog_url_names",
    """SELECT page_id, split_part(url, '/', -1) AS file_name, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
      CASE WHEN split_part(url, '/', -1) = '' THEN CAST(page_id AS VARCHAR) ELSE split_part(url, '/', -1) END AS row_id
    FROM pages""",
)
def catalog_url_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.select(
        "page_id",
        R.file_name(F.col("url")).alias("file_name"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        R.row_id([F.lit(None), R.file_name(F.col("url"))], F.col("page_id")).alias("row_id"),
    )


@query(
    "catalog_dataset_ref",
    """WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'custom:' || lang || ':' || source || ':' || CAST(doc_id AS VARCHAR)
        WHEN 1 THEN 'custom:' || source WHEN 2 THEN 'CV-valid-dev' WHEN 3 THEN 'Common-Voice' ELSE 'ravdess' END AS name FROM documents)
    SELECT doc_id, name, CASE WHEN starts_with(name, 'custom:') THEN (CASE WHEN doc_id % 5 = 0 THEN 'custom' ELSE 'invalid' END) ELSE 'global' END AS kind,
      CASE WHEN doc_id % 5 = 0 THEN split_part(name, ':', 2) END AS session_id,
      CASE doc_id % 5 WHEN 0 THEN split_part(name, ':', 3) || ':' || split_part(name, ':', 4) WHEN 1 THEN NULL WHEN 4 THEN 'ravdess' ELSE 'common-voice' END AS dataset
    FROM n""",
)
def catalog_dataset_ref(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 5
    name = (
        F.when(k == 0, F.concat_ws(":", F.lit("custom"), "lang", "source", F.col("doc_id").cast("string")))
        .when(k == 1, F.concat(F.lit("custom:"), "source"))
        .when(k == 2, "CV-valid-dev")
        .when(k == 3, "Common-Voice")
        .otherwise("ravdess")
    )
    named = documents(spark, sf).select("doc_id", name.alias("name"))
    return named.select("doc_id", "name", R.dataset_ref(F.col("name")).alias("r")).select("doc_id", "name", "r.*")


# Every third name is one that a copy of the language's plain name could be given, every eleventh one that a copy of that could. The SQL
# walks through the arrivals of each source with the list of names given so far.
ARRIVING_SQL = """a AS MATERIALIZED (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k,
  lang || CASE WHEN doc_id % 3 = 0 THEN '_' || CAST(n_chars % 40 + 1 AS VARCHAR) ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN '_1' ELSE '' END AS stem FROM documents),
g(source, k, doc_id, stem, given, held) AS (SELECT source, k, doc_id, stem, stem, [stem] FROM a WHERE k = 1
  UNION ALL SELECT source, k, doc_id, stem, given, list_append(held, given) FROM (
    SELECT a.source, a.k, a.doc_id, a.stem, held, CASE WHEN NOT list_contains(held, a.stem) THEN a.stem
      ELSE list_filter(list_transform(range(1, CAST(a.k AS BIGINT) + 1), lambda c: a.stem || '_' || CAST(c AS VARCHAR)), lambda n: NOT list_contains(held, n))[1] END AS given
    FROM g JOIN a ON a.source IS NOT DISTINCT FROM g.source AND a.k = g.k + 1))"""


@query(
    "catalog_dedupe_names",
    f"""WITH RECURSIVE {ARRIVING_SQL} SELECT doc_id, source, stem || '.wav' AS original_filename, given || '.wav' AS filename FROM g""",
)
def catalog_dedupe_names(spark: SparkSession, sf: str) -> DataFrame:
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_"), (F.col("n_chars") % 40 + 1).cast("string"))).otherwise("")
    stem = F.concat("lang", number, F.when(F.col("doc_id") % 11 == 0, "_1").otherwise(""))
    files = documents(spark, sf).select("doc_id", "source", F.concat(stem, F.lit(".wav")).alias("original_filename"))
    return C.dedupe_filenames(files, ["source"], "original_filename", "doc_id")


@query(
    "catalog_dataset_summary",
    f"""WITH s AS (SELECT source, count(*) AS files, sum(n_chars / 1000.0) AS total_duration, CAST(sum(n_chars * n_chars) AS BIGINT) AS total_size,
        list(lang || '_' || CAST(doc_id AS VARCHAR) ORDER BY doc_id)[1:3] AS f FROM documents GROUP BY source),
    p AS (SELECT *, CASE WHEN total_size < 1024 THEN 0 WHEN total_size < 1048576 THEN 1 WHEN total_size < 1073741824 THEN 2 ELSE 3 END AS i FROM s)
    SELECT source, files, {sql_rnd('total_duration', 4)} AS total_duration, total_size, array_to_string(f, ', ') AS first_files,
      CASE WHEN total_size = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', round(total_size / pow(1024, i), 2)), '\\.?0+$', '') || ' ' ||
        ['Bytes', 'KB', 'MB', 'GB'][i + 1] END AS size_text FROM p""",
)
def catalog_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    files = documents(spark, sf).withColumn("name", F.concat_ws("_", "lang", F.col("doc_id").cast("string")))
    size = F.col("n_chars") * F.col("n_chars")
    summary = C.dataset_summary(files, ["source"], "name", F.col("n_chars") / 1000.0, size, "doc_id")
    return summary.withColumn("total_duration", rnd("total_duration", 4))


@query(
    "catalog_files_as_rows",
    """SELECT source AS dataset, CAST(doc_id AS VARCHAR) AS filename, CAST(n_chars AS VARCHAR) AS size,
      CASE WHEN lang = 'en' THEN '16000' ELSE '0' END AS sample_rate FROM documents""",
)
def catalog_files_as_rows(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.struct(
        F.col("doc_id").alias("filename"),
        F.col("n_chars").alias("size"),
        F.when(F.col("lang") == "en", 16000).alias("sample_rate"),
    )
    # one nested row per file stands for a dataset document, so nothing is collected to build the input
    nested = documents(spark, sf).select(F.col("source").alias("dataset"), F.array(entry).alias("files"))
    return C.files_as_rows(nested)


@query(
    "catalog_combined_view",
    """SELECT 0 AS source_rank, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 1, s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def catalog_combined_view(spark: SparkSession, sf: str) -> DataFrame:
    uploaded = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    dataset = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return C.combined_view(uploaded, dataset)


@query(
    "rows_first_nonempty",
    """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), nullif(CASE WHEN d.lang = 'en' THEN '' ELSE d.lang END, ''), 'none') AS shown
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def rows_first_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    joined = documents(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    lang = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return joined.select("doc_id", R.first_nonempty(F.col("quality"), lang, default="none").alias("shown"))


@query(
    "rows_prediction_text",
    """WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN event_type
        WHEN 2 THEN '{"predicted_transcript": "", "prediction": "' || event_type || '"}' ELSE '{"text": "' || event_type || '"}' END AS payload FROM events)
    SELECT event_id, CASE WHEN starts_with(payload, '{') THEN coalesce(nullif(json_extract_string(payload, '$.predicted_transcript'), ''),
       nullif(json_extract_string(payload, '$.predicted_emotion'), ''), nullif(json_extract_string(payload, '$.prediction'), ''),
       nullif(json_extract_string(payload, '$.text'), ''), payload) ELSE payload END AS shown FROM p""",
)
def rows_prediction_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    payload = (
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.col("event_type"))
        .when(k == 2, F.concat(F.lit('{"predicted_transcript": "", "prediction": "'), "event_type", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"text": "'), "event_type", F.lit('"}')))
    )
    return table(spark, sf, "events").select("event_id", R.prediction_text(payload).alias("shown"))


@query(
    "rows_search",
    """SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red')""",
)
def rows_search(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return C.search(part, "RED", ["p_name", "p_brand"])


@query(
    "rows_page",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
)
def rows_page(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.page(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], number=2)


MODELS_SQL = "['whisper-base', 'wav2vec2', 'whisper-large', 'other']"
DATASETS_SQL = "['common-voice', 'ravdess', 'custom:s:n']"


@query(
    "rows_truth_applicable",
    f"""WITH m AS (SELECT event_id, {MODELS_SQL}[event_id % 4 + 1] AS model, {DATASETS_SQL}[user_id % 3 + 1] AS dataset FROM events)
    SELECT model, dataset, CASE WHEN starts_with(model, 'whisper') THEN dataset = 'common-voice' WHEN model = 'wav2vec2' THEN dataset = 'ravdess' ELSE false END AS applies,
      count(*) AS n FROM m GROUP BY ALL""",
)
def rows_truth_applicable(spark: SparkSession, sf: str) -> DataFrame:
    models = F.array(*[F.lit(x) for x in ("whisper-base", "wav2vec2", "whisper-large", "other")])
    datasets = F.array(*[F.lit(x) for x in ("common-voice", "ravdess", "custom:s:n")])
    asked = table(spark, sf, "events").select(
        F.get(models, (F.col("event_id") % 4).cast("int")).alias("model"),
        F.get(datasets, (F.col("user_id") % 3).cast("int")).alias("dataset"),
    )
    applies = R.truth_applicable(F.col("model"), F.col("dataset")).alias("applies")
    return asked.groupBy("model", "dataset", applies).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rows_intensity_bucket",
    """SELECT CASE WHEN value / 100 > 0.7 THEN 'high' WHEN value / 100 > 0.4 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM events GROUP BY 1""",
)
def rows_intensity_bucket(spark: SparkSession, sf: str) -> DataFrame:
    bucket = R.intensity_bucket(F.col("value") / 100).alias("bucket")
    return table(spark, sf, "events").groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


def _label_case() -> str:
    rungs = []
    for label, marks in NAME_LABELS:
        rungs.append("WHEN " + " OR ".join(f"contains(lower(name), '{m}')" for m in marks) + f" THEN '{label}'")
    return "CASE " + " ".join(rungs) + " END"


@query(
    "rows_label_from_name",
    f"""WITH n AS (SELECT event_id, '03-01-0' || CAST(user_id % 9 AS VARCHAR) || '-02-0' || CAST(event_id % 3 AS VARCHAR) || '-Sad' || event_type || '.wav' AS name FROM events
      UNION ALL SELECT event_id, '03_02_0' || CAST(user_id % 9 AS VARCHAR) || ['JOY', 'calm', 'view'][event_id % 3 + 1] || '.wav' FROM events)
    SELECT event_id, name, {_label_case()} AS label,
      CASE split_part(name, '-', 3) {" ".join(f"WHEN '{m[0][-2:]}' THEN '{v}'" for v, m in NAME_LABELS)} END AS positional_label FROM n""",
)
def rows_label_from_name(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    speaker = (F.col("user_id") % 9).cast("string")
    dashed = F.concat(
        F.lit("03-01-0"), speaker, F.lit("-02-0"), (F.col("event_id") % 3).cast("string"), F.lit("-Sad"), "event_type", F.lit(".wav")
    )
    word = F.get(F.array(F.lit("JOY"), F.lit("calm"), F.lit("view")), (F.col("event_id") % 3).cast("int"))
    named = events.select("event_id", F.explode(F.array(dashed, F.concat(F.lit("03_02_0"), speaker, word, F.lit(".wav")))).alias("name"))
    return named.withColumns(
        {"label": R.label_from_filename(F.col("name")), "positional_label": R.label_from_position(F.col("name"))}
    )


FEATURE_STEMS = ("mfcc_", "Chroma ", "tonnetz-", "spectral_x", "mfcc_mfcc_", "Spectral Centroid", "zcr", "temporal_", "q")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ordinal_case() -> str:
    words = " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(ORDINALS, 1))
    return (
        f"CASE num WHEN 0 THEN '' {words} ELSE CAST(num AS VARCHAR) || CASE WHEN num % 100 >= 20 THEN "
        "(CASE num % 10 WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END) ELSE 'th' END END"
    )


@query(
    "rows_describe_feature",
    f"""WITH dict(feature, txt) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in FEATURE_TEXTS.items())}),
    n AS (SELECT DISTINCT [{", ".join(_quoted(s) for s in FEATURE_STEMS)}][event_id % 9 + 1] ||
            CASE WHEN event_id % 9 IN (5, 6) THEN '' ELSE CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) END AS feature FROM events),
    m AS (SELECT feature, regexp_replace(lower(feature), '[_\\s-]', '_', 'g') AS normal FROM n),
    k AS (SELECT *, TRY_CAST(nullif(regexp_extract(normal, '_(\\d+)$', 1), '') AS BIGINT) AS num, regexp_replace(normal, '_\\d+$', '_1') AS sibling FROM m)
    SELECT k.feature, coalesce(a.txt, b.txt, CASE WHEN num IS NULL THEN c.txt ELSE
        regexp_replace(c.txt, '{"|".join(ORDINALS[:13])}', {_ordinal_case()}) END,
        CASE {" ".join(f"WHEN contains(normal, '{p}') THEN {_quoted(t)}" for p, t in FEATURE_CLASS_TEXTS)} ELSE {_quoted(FEATURE_DEFAULT_TEXT)} END) AS explanation
    FROM k LEFT JOIN dict a ON a.feature = k.feature LEFT JOIN dict b ON b.feature = k.normal LEFT JOIN dict c ON c.feature = k.sibling""",
)
def rows_describe_feature(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("event_id") % 9).cast("int")
    stem = F.get(F.array(*[F.lit(s) for s in FEATURE_STEMS]), k)
    number = F.when(k.isin(5, 6), "").otherwise(F.get_json_object("props", "$.k"))
    names = table(spark, sf, "events").select(F.concat(stem, number).alias("feature")).distinct()
    return names.withColumn("explanation", R.describe_feature(F.col("feature")))


@query(
    "rows_scope_to_session",
    """SELECT event_id, value, true AS foreign_session FROM events WHERE user_id = 7 AND event_type = 'click'""",
)
def rows_scope_to_session(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "events").select(
        "event_id", "value", F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("dataset")
    )
    return C.scope_to_session(files, "3", "click", owner="7").drop("session_id", "dataset")


@query(
    "rows_check_cohort",
    """SELECT count(*) AS requested, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def rows_check_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return C.check_cohort(documents(spark, sf).select("doc_id"), table(spark, sf, "labels"), "doc_id")


# --- lookups ------------------------------------------------------------------------------------------------------------


def label_results(spark: SparkSession, sf: str) -> DataFrame:
    """The labels table as a partly filled result table."""
    return table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("payload"))


@query(
    "lookup_batch_check",
    """SELECT d.doc_id, CAST(l.quality AS VARCHAR) AS payload, l.doc_id IS NOT NULL AS cached FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def lookup_batch_check(spark: SparkSession, sf: str) -> DataFrame:
    return L.batch_check(documents(spark, sf).select("doc_id"), label_results(spark, sf), "doc_id")


@query("lookup_cached", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def lookup_cached(spark: SparkSession, sf: str) -> DataFrame:
    return L.cached_only(documents(spark, sf).select("doc_id", "lang"), label_results(spark, sf), "doc_id")


@query("lookup_missing", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lookup_missing(spark: SparkSession, sf: str) -> DataFrame:
    return L.missing_only(documents(spark, sf).select("doc_id", "lang"), label_results(spark, sf), "doc_id")


@query(
    "lookup_cache_info",
    f"""SELECT count(l.doc_id) AS cached_count, count(*) - count(l.doc_id) AS missing_count, {sql_rnd("count(l.doc_id) / count(*)")} AS cache_hit_rate
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def lookup_cache_info(spark: SparkSession, sf: str) -> DataFrame:
    info = L.cache_info(lookup_batch_check(spark, sf))
    return info.withColumn("cache_hit_rate", rnd("cache_hit_rate"))


# Metadata rows: the documents twice under one name in three, a third of them with the folder prefix.
TRUTH_SQL = """meta AS (SELECT doc_id AS "row", CASE doc_id % 3 WHEN 0 THEN 'cv-valid-dev/' ELSE '' END || lang || '_' || CAST(n_chars AS VARCHAR) AS filename,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS sentence FROM documents),
  req AS (SELECT d.doc_id, lang || '_' || CAST(n_chars AS VARCHAR) AS filename FROM documents d)"""


@query(
    "lookup_ground_truth",
    f"""WITH {TRUTH_SQL},
    best AS (SELECT filename, arg_min(coalesce(sentence, 'nan'), "row") AS v FROM meta GROUP BY filename)
    SELECT r.doc_id, r.filename, coalesce(a.v, b.v) AS ground_truth FROM req r LEFT JOIN best a ON a.filename = r.filename
    LEFT JOIN best b ON b.filename = 'cv-valid-dev/' || r.filename""",
)
def lookup_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("_", "lang", F.col("n_chars").cast("string"))
    docs = documents(spark, sf)
    meta = docs.select(
        F.col("doc_id").alias("row"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, "cv-valid-dev/").otherwise(""), name).alias("filename"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("sentence"),
    )
    return L.attach_ground_truth(docs.select("doc_id", name.alias("filename")), meta, "common-voice")


@query(
    "lookup_label_truth",
    """SELECT d.doc_id AS filename, nullif(CASE WHEN l.toxic = 1 THEN '' ELSE CAST(l.quality AS VARCHAR) END, '') AS ground_truth
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def lookup_label_truth(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "labels").select(
        F.col("doc_id").alias("filename"),
        F.col("doc_id").alias("row"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("quality").cast("string")).alias("label"),
    )
    return L.attach_label_truth(documents(spark, sf).select(F.col("doc_id").alias("filename")), meta, "ravdess")


@query(
    "lookup_two_keys",
    """SELECT d.doc_id, CAST(coalesce(a.quality, b.quality) AS VARCHAR) AS payload FROM documents d
    LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id + 1""",
)
def lookup_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    files = documents(spark, sf).select("doc_id", F.col("doc_id").alias("own"), (F.col("doc_id") + 1).alias("owner"))
    results = label_results(spark, sf).withColumnRenamed("doc_id", "key")
    return L.two_key_lookup(files, results, "own", "owner").select("doc_id", "payload")


@query(
    "lookup_apply_predictions",
    """SELECT d.doc_id, d.source || '/' || CAST(d.doc_id AS VARCHAR) AS path, CAST(l.quality AS VARCHAR) AS payload,
      CASE WHEN l.doc_id IS NULL THEN 'idle' ELSE 'done' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def lookup_apply_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    results = label_results(spark, sf).select(F.col("doc_id").cast("string").alias("file"), "payload")
    return L.apply_predictions(rows, results, "path")


# Wanted values: the page's own id, the last piece of its URL, and the last two pieces.
@query(
    "lookup_match_selection",
    """WITH wanted AS (SELECT DISTINCT unnest([CAST(page_id AS VARCHAR), split_part(url, '/', -1), split_part(url, '/', -2) || '/' || split_part(url, '/', -1)]) AS wanted
        FROM pages WHERE page_id IN (SELECT doc_id FROM labels))
    SELECT p.page_id, w.wanted FROM pages p, wanted w WHERE CAST(p.page_id AS VARCHAR) = w.wanted OR p.url = w.wanted
      OR ends_with(p.url, '/' || w.wanted) OR ends_with(p.url, '\\' || w.wanted)""",
)
def lookup_match_selection(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    pieces = F.split("url", "/")
    chosen = pages.join(table(spark, sf, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi")
    wanted = chosen.select(
        F.explode(
            F.array(
                F.col("page_id").cast("string"),
                F.element_at(pieces, -1),
                F.concat_ws("/", F.element_at(pieces, -2), F.element_at(pieces, -1)),
            )
        ).alias("wanted")
    )
    return L.match_selection(pages, wanted, "page_id", "url").select("page_id", "wanted")
