"""Perturbation queries and waveform features. Waves: the embeddings as 64 samples at 16 kHz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions import signal as N
from sonarium.operators import robust as P
from sonarium.operators import series as S
from sonarium.operators.labels import predict_labels
from sonarium.plans.cohort import ID2LABEL, NAMES_SQL
from sonarium.plans.registry import query, rnd, spread, sql_rnd, table
from sonarium.plans.text import edited, sql_words

RATE = 16000


def waves(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("clip"), F.col("embedding").cast("array<double>").alias("wave"), F.lit(RATE).alias("rate")
    )


def samples(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select("clip", F.posexplode("wave").alias("i", "x")).withColumn("x", rnd("x", digits))


WAVES_SQL = """v AS (SELECT vec_id AS clip, CAST(k AS INTEGER) AS i, embedding[k + 1]::DOUBLE AS x FROM embeddings, range(64) r(k))"""


NOISE_SQL = """u AS (SELECT *, md5(CAST(clip AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|0') AS h FROM v),
n AS (SELECT clip, i, x, (CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS a, (CAST('0x' || substr(h, 14, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS b FROM u)"""


@query("robust_noise", f"WITH {WAVES_SQL}, {NOISE_SQL} SELECT clip, i, {sql_rnd('x + 0.005::DOUBLE * sqrt(-2 * ln(a)) * cos(2 * pi() * b)', 9)} AS x FROM n")
def robust_noise(spark: SparkSession, sf: str) -> DataFrame:
    return samples(waves(spark, sf).withColumn("wave", N.add_noise(F.col("wave"), F.col("clip"))))


@query("robust_time_mask", f"WITH {WAVES_SQL} SELECT clip, i, {sql_rnd('CASE WHEN i >= 12 AND i < 25 THEN 0.0 ELSE x END', 9)} AS x FROM v")
def robust_time_mask(spark: SparkSession, sf: str) -> DataFrame:
    return samples(waves(spark, sf).withColumn("wave", N.mask_time(F.col("wave"), F.col("clip"), floor=0.0)))


# Bins 4 to 8 of 64 at 16 kHz are 1000 to 2000 Hz; taking them out once (one side) or with their mirror images (two sides).
def band_sql(source: str, factor: int) -> str:
    return f"""spec AS (SELECT clip, b, sum(x * cos(2 * pi() * b * i / 64)) AS re, -sum(x * sin(2 * pi() * b * i / 64)) AS im FROM {source}, range(4, 9) r(b) GROUP BY clip, b),
    part AS (SELECT clip, CAST(t AS INTEGER) AS i, sum(re * cos(2 * pi() * b * t / 64) - im * sin(2 * pi() * b * t / 64)) / 64 AS y FROM spec, range(64) r(t) GROUP BY clip, t),
    masked AS (SELECT clip, i, x - {factor} * y AS x FROM {source} JOIN part USING (clip, i))"""


@query("robust_band_mask", f"WITH {WAVES_SQL}, {band_sql('v', 1)} SELECT clip, i, {sql_rnd('x', 9)} AS x FROM masked")
def robust_band_mask(spark: SparkSession, sf: str) -> DataFrame:
    return samples(waves(spark, sf).withColumn("wave", N.mask_band(F.col("wave"), F.col("rate"))))


@query("robust_band_removed", f"WITH {WAVES_SQL}, {band_sql('v', 2)} SELECT clip, i, {sql_rnd('x', 9)} AS x FROM masked")
def robust_band_removed(spark: SparkSession, sf: str) -> DataFrame:
    return samples(waves(spark, sf).withColumn("wave", N.mask_band(F.col("wave"), F.col("rate"), two_sided=True)))


CHAIN = [
    {"type": "time_masking", "params": {"mask_start_percent": 50}},
    {"type": "pitch_shift", "params": {"pitch_shift_semitones": 2}},
    {"type": "time_masking", "params": {"mask_start_percent": "low", "mask_end_percent": 90}},
    {"type": "frequency_masking"},
    {"type": "time_masking", "params": {"mask_start_percent": 10, "mask_end_percent": 25}},
]


# the first mask is empty (50 to 40 percent), so the chain is a band mask, then silence in samples 6 to 15
@query(
    "robust_chain",
    f"""WITH {WAVES_SQL}, {band_sql('v', 1)} SELECT clip, i, {sql_rnd('CASE WHEN i >= 6 AND i < 16 THEN 0.0 ELSE x END', 9)} AS x FROM masked""",
)
def robust_chain(spark: SparkSession, sf: str) -> DataFrame:
    return samples(P.perturb_chain(waves(spark, sf), CHAIN, floor=0.0))


@query(
    "robust_chain_outcomes",
    """SELECT vec_id AS clip, CAST(s AS INTEGER) AS step, ['time_masking', 'pitch_shift', 'time_masking', 'frequency_masking', 'time_masking'][s + 1] AS type,
      ['applied', 'unsupported', 'failed', 'applied', 'applied'][s + 1] AS status, [50.0::DOUBLE, NULL, NULL, NULL, 10.0][s + 1] AS mask_start FROM embeddings, range(5) r(s)""",
)
def robust_chain_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    done = P.perturb_chain(waves(spark, sf), CHAIN, floor=0.0)
    steps = done.select("clip", F.posexplode("applied_perturbations").alias("step", "o"))
    return steps.select(
        "clip", "step", "o.type", "o.status", F.try_element_at("o.params", F.lit("mask_start_percent")).alias("mask_start")
    )


# every third sample of every seventh clip is damaged, and all are scaled up so that some peaks exceed 1
@query(
    "robust_finish",
    f"""WITH {WAVES_SQL}, d AS (SELECT clip, i, CASE WHEN clip % 7 = 0 AND i % 3 = 0 THEN 0.0 ELSE x * 4 END AS x FROM v), p AS (SELECT *, max(abs(x)) OVER (PARTITION BY clip) AS p FROM d)
    SELECT clip, i, {sql_rnd('CASE WHEN p > 1 THEN x / p ELSE x END', 9)} AS x, CAST(4 AS BIGINT) AS duration_ms, 'clip' || CAST(clip AS VARCHAR) || '_perturbed_' AS name_start, true AS name_ok FROM p""",
)
def robust_finish(spark: SparkSession, sf: str) -> DataFrame:
    def damage(x: Column, i: Column) -> Column:
        return F.when((F.col("clip") % 7 == 0) & (i % 3 == 0), float("nan")).otherwise(x * 4)

    loud = waves(spark, sf).withColumn("wave", F.transform("wave", damage))
    named = loud.withColumn("path", F.concat(F.lit("set/clip"), F.col("clip").cast("string"), F.lit(".wav")))
    done = P.finish_perturbed(named, "path")
    return done.select(
        "clip",
        "duration_ms",
        F.regexp_extract("filename", "^(.*_perturbed_)", 1).alias("name_start"),
        F.col("filename").rlike("_perturbed_[0-9a-f]{8}\\.wav$").alias("name_ok"),
        F.posexplode("wave").alias("i", "x"),
    ).withColumn("x", rnd("x", 9))


# --- comparison ---------------------------------------------------------------------------------------------------------


def predictions(spark: SparkSession, sf: str, factor: float) -> DataFrame:
    """Labels from the embedding as logits, scaled, with the sign of the second value turned for the perturbed copy."""
    scaled = F.transform(
        "embedding", lambda x, i: x.cast("double") * factor * F.when((i == 1) & F.lit(factor != 1), -1).otherwise(1)
    )
    return predict_labels(table(spark, sf, "embeddings").select("vec_id", scaled.alias("logits")), "logits", ID2LABEL)


def probs_sql(name: str, factor: float) -> str:
    turned = "" if factor == 1 else " * CASE WHEN i = 2 THEN -1 ELSE 1 END"
    return f"""{name}_l AS (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE * {factor}{turned}) AS l FROM embeddings),
{name}_e AS (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM {name}_l),
{name} AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, list_position(e, list_max(e)) AS b FROM {name}_e)"""


BOTH_SQL = f"{probs_sql('a', 1)}, {probs_sql('z', 3)}"


@query(
    "robust_probability_shift",
    f"""WITH {BOTH_SQL}, s AS (SELECT vec_id, coalesce({NAMES_SQL}[k], 'emotion_' || CAST(k - 1 AS VARCHAR)) AS label, shift FROM (SELECT vec_id, unnest(range(1, len(a.p) + 1)) AS k, unnest(list_transform(z.p, lambda v, i: (v - a.p[i]) * 100)) AS shift FROM a JOIN z USING (vec_id)))
    SELECT vec_id, label, {sql_rnd('shift')} AS shift, abs(shift) > 1 AS significant, CASE WHEN shift > 0 THEN 'up' WHEN shift < 0 THEN 'down' ELSE 'same' END AS direction FROM s""",
)
def robust_probability_shift(spark: SparkSession, sf: str) -> DataFrame:
    shift = P.probability_shift(predictions(spark, sf, 1), predictions(spark, sf, 3), "vec_id")
    return shift.withColumn("shift", rnd("shift"))


@query(
    "robust_label_flip",
    f"""WITH {BOTH_SQL} SELECT vec_id, coalesce({NAMES_SQL}[a.b], CAST(a.b - 1 AS VARCHAR)) AS label_before, coalesce({NAMES_SQL}[z.b], CAST(z.b - 1 AS VARCHAR)) AS label_after, a.b <> z.b AS flipped
    FROM a JOIN z USING (vec_id)""",
)
def robust_label_flip(spark: SparkSession, sf: str) -> DataFrame:
    return P.label_flips(predictions(spark, sf, 1), predictions(spark, sf, 3), "vec_id")


@query(
    "robust_flip_rate",
    f"""WITH {BOTH_SQL} SELECT count(*) AS files, count(*) FILTER (a.b <> z.b) AS flipped, {sql_rnd('count(*) FILTER (a.b <> z.b) / count(*)')} AS flip_rate FROM a JOIN z USING (vec_id)""",
)
def robust_flip_rate(spark: SparkSession, sf: str) -> DataFrame:
    return P.flip_rate(robust_label_flip(spark, sf)).withColumn("flip_rate", rnd("flip_rate"))


# Before: the text itself; after: the edited text of the accuracy queries; the truth is known for labelled documents only.
@query(
    "robust_transcript_change",
    f"""WITH d AS (SELECT doc_id, CAST(len({sql_words('text')}) AS BIGINT) AS n, text, array_to_string([CASE WHEN (i - 1) % 11 = 10 THEN '0zq0' ELSE w END
        for w, i in {sql_words('text')} if (i - 1) % 7 <> 6], ' ') AS e FROM documents)
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE CAST(0 AS DOUBLE) END AS word_error_rate_before,
      CASE WHEN l.doc_id IS NULL THEN NULL WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE {sql_rnd('least((n // 7 + n // 11 - n // 77) / n, 1.0)')} END AS word_error_rate_after, d.text <> e AS changed
    FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def robust_transcript_change(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known"))
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text", edited(F.col("text")).alias("edited"))
    joined = docs.join(known, "doc_id", "left").withColumn("truth", F.when(F.col("known"), F.col("text")))
    change = P.transcript_change(joined, "text", "edited", "truth", ["word_error_rate"])
    return change.select(
        "doc_id", *[rnd(c).alias(c) for c in ("word_error_rate_before", "word_error_rate_after")], "changed"
    )


# --- features of waveforms ----------------------------------------------------------------------------------------------

FRAME, HOP = 16, 8
FRAMES_SQL = f"fr AS (SELECT clip, f, i - f * {HOP} AS k, x, lag(x) OVER (PARTITION BY clip, f ORDER BY i) AS px FROM v, range({(64 - FRAME) // HOP + 1}) r(f) WHERE i >= f * {HOP} AND i < f * {HOP} + {FRAME})"


def stats_sql(col: str) -> str:
    return ", ".join(f"{sql_rnd(f'{fn}({col})')} AS {col}_{s}" for s, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query(
    "series_frame_features",
    f"""WITH {WAVES_SQL}, fr AS (SELECT clip, f, x, lag(x) OVER (PARTITION BY clip, f ORDER BY i) AS px FROM v, range({64 // HOP + 1}) r(f)
      WHERE i + {FRAME // 2} >= f * {HOP} AND i + {FRAME // 2} < f * {HOP} + {FRAME}),
    g AS (SELECT clip, f, sqrt(sum(x * x) / {FRAME}) AS rms_energy, count(*) FILTER ((x < -1e-10) <> (px < -1e-10)) / {FRAME} AS zero_crossing_rate FROM fr GROUP BY clip, f)
    SELECT clip, 64 / {RATE}::DOUBLE AS duration, {RATE} AS sample_rate, {stats_sql('rms_energy')}, {stats_sql('zero_crossing_rate')} FROM g GROUP BY clip""",
)
def series_frame_features(spark: SparkSession, sf: str) -> DataFrame:
    long = S.series_from_arrays(waves(spark, sf), "clip", "wave")
    features = S.frame_features(long, RATE, FRAME, HOP)
    plain = ("clip", "duration", "sample_rate")
    return features.select(*plain, *[rnd(c).alias(c) for c in features.columns if c not in plain])


@query(
    "series_spectral_features",
    f"""WITH {WAVES_SQL}, {FRAMES_SQL},
    w AS (SELECT clip, f, k, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / {FRAME})) AS y FROM fr),
    m AS (SELECT clip, f, b, sqrt(pow(sum(y * cos(2 * pi() * b * k / {FRAME})), 2) + pow(sum(y * sin(2 * pi() * b * k / {FRAME})), 2)) AS a FROM w, range({FRAME // 2 + 1}) r(b) GROUP BY clip, f, b),
    c AS (SELECT *, b * {RATE}::DOUBLE / {FRAME} AS hz, sum(a) OVER (PARTITION BY clip, f) AS tot, sum(a) OVER (PARTITION BY clip, f ORDER BY b) AS cum FROM m),
    g AS (SELECT clip, f, sum(a * hz) / max(tot) AS spectral_centroid, min(CASE WHEN cum >= 0.85::DOUBLE * tot THEN hz END) AS spectral_rolloff FROM c GROUP BY clip, f),
    h AS (SELECT g.*, bw AS spectral_bandwidth FROM g JOIN (SELECT c.clip, c.f, sqrt(sum(a / tot * pow(hz - spectral_centroid, 2))) AS bw FROM c JOIN g ON g.clip = c.clip AND g.f = c.f GROUP BY ALL) b ON b.clip = g.clip AND b.f = g.f)
    SELECT clip, {stats_sql('spectral_centroid')}, {stats_sql('spectral_bandwidth')}, {stats_sql('spectral_rolloff')} FROM h GROUP BY clip""",
)
def series_spectral_features(spark: SparkSession, sf: str) -> DataFrame:
    shaped = waves(spark, sf).withColumn("s", N.spectral_features(F.col("wave"), F.col("rate"), FRAME, HOP))
    return shaped.select("clip", *[rnd(f"s.{c}").alias(c) for c in N.SPECTRAL_TYPE.names])
