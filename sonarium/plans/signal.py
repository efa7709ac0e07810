"""Series queries. Clips: the event types with their values in order, and the embeddings as 64-sample signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.operators import series as S
from sonarium.operators.blocks import number_rows
from sonarium.plans.registry import query, rnd, sql_rnd, table


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("clip"), "event_id", ((F.col("value") - 100) / 100).alias("x")
    )
    return number_rows(events, ["clip"], "event_id", "i").select("clip", "i", "x")


SERIES_SQL = """s AS (SELECT event_type AS clip, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, (value - 100) / 100 AS x FROM events),
n AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n FROM s)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as the frames of the clip given by their label."""
    e = number_rows(table(spark, sf, "embeddings"), ["label"], "vec_id", "frame")
    return e.select(F.col("label").alias("clip"), "frame", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


FRAMES_SQL = """f AS (SELECT label AS clip, frame, unnest(embedding)::DOUBLE AS value FROM (
  SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings)),
c AS (SELECT clip, frame AS i, avg(abs(value)) AS x FROM f GROUP BY clip, frame)"""


@query("series_index", f"WITH {SERIES_SQL} SELECT clip, i, {sql_rnd('x')} AS x FROM s")
def series_index(spark: SparkSession, sf: str) -> DataFrame:
    return event_series(spark, sf).withColumn("x", rnd("x"))


@query(
    "series_rms",
    f"""WITH {SERIES_SQL} SELECT clip, i // (n // 300) AS point, {sql_rnd('sqrt(avg(x * x))')} AS rms FROM n WHERE n >= 300 AND i // (n // 300) < 300 GROUP BY ALL""",
)
def series_rms(spark: SparkSession, sf: str) -> DataFrame:
    return S.rms_downsample(event_series(spark, sf)).withColumn("rms", rnd("rms"))


BAD_SQL = "CASE WHEN i % 11 = 3 THEN 'nan'::DOUBLE WHEN i % 13 = 5 THEN 'infinity'::DOUBLE WHEN i % 17 = 7 THEN '-infinity'::DOUBLE ELSE x END"


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("i")
    x = (
        F.when(i % 11 == 3, float("nan")).when(i % 13 == 5, float("inf")).when(i % 17 == 7, float("-inf")).otherwise(F.col("x"))
    )
    return event_series(spark, sf).withColumn("x", x)


@query(
    "series_sanitize",
    f"""WITH {SERIES_SQL}, b AS (SELECT clip, i, {BAD_SQL} AS x FROM s) SELECT clip, i, {sql_rnd('CASE WHEN isnan(x) OR isinf(x) THEN 0.0 ELSE x END')} AS x FROM b""",
)
def series_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return S.sanitize(damaged(spark, sf)).withColumn("x", rnd("x"))


@query(
    "series_bad_samples",
    f"""WITH {SERIES_SQL}, b AS (SELECT clip, {BAD_SQL} AS x FROM s) SELECT clip, count(*) FILTER (isnan(x) OR isinf(x)) AS bad, count(*) AS samples FROM b GROUP BY clip""",
)
def series_bad_samples(spark: SparkSession, sf: str) -> DataFrame:
    return S.bad_samples(damaged(spark, sf))


@query(
    "series_peak_normalize",
    f"""WITH {SERIES_SQL}, p AS (SELECT *, max(abs(x)) OVER (PARTITION BY clip) AS p FROM s) SELECT clip, i, {sql_rnd('CASE WHEN p > 1.0 THEN x / p ELSE x END')} AS x FROM p""",
)
def series_peak_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return S.peak_normalize(event_series(spark, sf)).withColumn("x", rnd("x"))


# Samples below zero count as silent; at three samples per second a run of three lasts a second.
@query(
    "series_silent_runs",
    f"""WITH {SERIES_SQL}, q AS (SELECT clip, i, i - row_number() OVER (PARTITION BY clip ORDER BY i) AS run FROM s WHERE x < 0)
    SELECT clip, min(i) AS start, max(i) AS "end", count(*) AS samples FROM q GROUP BY clip, run HAVING count(*) >= 3""",
)
def series_silent_runs(spark: SparkSession, sf: str) -> DataFrame:
    gated = event_series(spark, sf).withColumn("x", F.when(F.col("x") < 0, 0.0).otherwise(F.col("x") + 1))
    return S.silent_runs(gated, rate=3)


@query("series_crop", f"WITH {SERIES_SQL} SELECT clip, i, {sql_rnd('x')} AS x FROM s WHERE i < 1200")
def series_crop(spark: SparkSession, sf: str) -> DataFrame:
    return S.crop(event_series(spark, sf), rate=100, max_seconds=12).withColumn("x", rnd("x"))


WIDTH_SQL = "(greatest(3, n // 64) + CASE WHEN greatest(3, n // 64) % 2 = 0 THEN 1 ELSE 0 END)"
SMOOTH_SQL = f"""w AS (SELECT *, CAST({WIDTH_SQL} AS BIGINT) AS w FROM n),
sm AS (SELECT clip, i, n, sum(x) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN (w // 2) PRECEDING AND (w // 2) FOLLOWING) / w AS x FROM w)"""


@query("series_smooth_centered", f"WITH {SERIES_SQL}, {SMOOTH_SQL} SELECT clip, i, {sql_rnd('x')} AS x FROM sm")
def series_smooth_centered(spark: SparkSession, sf: str) -> DataFrame:
    return S.smooth_centered(event_series(spark, sf)).withColumn("x", rnd("x"))


@query(
    "series_smooth_trailing",
    f"""WITH {SERIES_SQL}, w AS (SELECT *, CAST(greatest(1, floor(n / 100 * (0.1 + 0.9 * 0.5))) AS BIGINT) AS w FROM n)
    SELECT clip, i, {sql_rnd('avg(x) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN (w - 1) PRECEDING AND CURRENT ROW)', 7)} AS x FROM w""",
)
def series_smooth_trailing(spark: SparkSession, sf: str) -> DataFrame:
    return S.smooth_trailing(event_series(spark, sf), 0.5).withColumn("x", rnd("x", 7))


@query(
    "series_clip_percentile",
    f"""WITH {SERIES_SQL}, p AS (SELECT clip, quantile_cont(x, 0.95) AS p FROM s GROUP BY clip)
    SELECT clip, i, {sql_rnd('CASE WHEN p > 0 THEN greatest(0.0, least(x, p)) ELSE x END')} AS x FROM s JOIN p USING (clip)""",
)
def series_clip_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return S.clip_percentile(event_series(spark, sf)).withColumn("x", rnd("x"))


@query(
    "series_clip_display",
    f"""WITH {SERIES_SQL}, p AS (SELECT clip, list_sort(list(x))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS p FROM s GROUP BY clip)
    SELECT clip, i, {sql_rnd('least(x, CASE WHEN p = 0 THEN 1.0 ELSE p END)')} AS x FROM s JOIN p USING (clip)""",
)
def series_clip_display(spark: SparkSession, sf: str) -> DataFrame:
    return S.clip_display(event_series(spark, sf), 90).withColumn("x", rnd("x"))


MINMAX = "(x - min(x) OVER (PARTITION BY clip)) / (max(x) OVER (PARTITION BY clip) - min(x) OVER (PARTITION BY clip) + 1e-9)"


@query("series_minmax", f"WITH {SERIES_SQL} SELECT clip, i, {sql_rnd(MINMAX)} AS x FROM s")
def series_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return S.minmax(event_series(spark, sf)).withColumn("x", rnd("x"))


@query("series_absmax", f"WITH {SERIES_SQL} SELECT clip, i, {sql_rnd('abs(x) / max(abs(x)) OVER (PARTITION BY clip)')} AS x FROM s")
def series_absmax(spark: SparkSession, sf: str) -> DataFrame:
    return S.absmax_scale(event_series(spark, sf)).withColumn("x", rnd("x"))


@query("series_collapse", f"WITH {FRAMES_SQL} SELECT clip, i, {sql_rnd('x', 9)} AS x FROM c")
def series_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return S.collapse_attribution(frames(spark, sf)).withColumn("x", rnd("x", 9))


@query("series_energy", f"WITH {FRAMES_SQL} SELECT clip, i, {sql_rnd(MINMAX)} AS x FROM c")
def series_energy(spark: SparkSession, sf: str) -> DataFrame:
    return S.energy_series(frames(spark, sf)).withColumn("x", rnd("x"))


# Odd labels get a constant series and so fall back on their energy.
@query(
    "series_flat_fallback",
    f"""WITH {FRAMES_SQL}, own AS (SELECT clip, i, x FROM c WHERE clip % 2 = 0),
    energy AS (SELECT clip, i, {MINMAX} AS x FROM c)
    SELECT clip, i, {sql_rnd('x')} AS x, 'own' AS source FROM own UNION ALL SELECT clip, i, {sql_rnd('x')}, 'energy' FROM energy WHERE clip % 2 = 1""",
)
def series_flat_fallback(spark: SparkSession, sf: str) -> DataFrame:
    fr = frames(spark, sf)
    collapsed = S.collapse_attribution(fr)
    own = collapsed.withColumn("x", F.when(F.col("clip") % 2 == 1, 0.25).otherwise(F.col("x")))
    clips = table(spark, sf, "embeddings").select(F.col("label").alias("clip")).distinct()
    return S.flat_fallback(own, S.energy_series(fr), clips).withColumn("x", rnd("x"))


@query(
    "series_saliency",
    f"""WITH {SERIES_SQL}, {SMOOTH_SQL}, p AS (SELECT clip, quantile_cont(x, 0.95) AS p FROM sm GROUP BY clip),
    cl AS (SELECT clip, i, CASE WHEN p > 0 THEN greatest(0.0, least(x, p)) ELSE x END AS x FROM sm JOIN p USING (clip))
    SELECT clip, i, {sql_rnd(MINMAX)} AS x FROM cl""",
)
def series_saliency(spark: SparkSession, sf: str) -> DataFrame:
    return S.saliency_series(event_series(spark, sf)).withColumn("x", rnd("x"))


@query(
    "series_display",
    f"""WITH {SERIES_SQL}, w AS (SELECT *, CAST(greatest(1, floor(n / 100 * (0.1 + 0.9 * 0.5))) AS BIGINT) AS w FROM n),
    t AS (SELECT clip, i, avg(x) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN (w - 1) PRECEDING AND CURRENT ROW) AS x FROM w),
    p AS (SELECT clip, list_sort(list(x))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p FROM t GROUP BY clip),
    c AS (SELECT clip, i, least(x, CASE WHEN p = 0 THEN 1.0 ELSE p END) AS x FROM t JOIN p USING (clip)),
    r AS (SELECT *, min(x) OVER (PARTITION BY clip) AS lo, max(x) OVER (PARTITION BY clip) AS hi FROM c)
    SELECT clip, i, {sql_rnd('(x - lo) / greatest(1e-9, hi - lo)')} AS x FROM r""",
)
def series_display(spark: SparkSession, sf: str) -> DataFrame:
    return S.display_series(event_series(spark, sf)).withColumn("x", rnd("x"))


@query(
    "series_chunks",
    f"WITH {SERIES_SQL} SELECT clip, i // 300 AS chunk, CAST((i // 300) * 30 AS DOUBLE) AS offset_s, count(*) AS samples, {sql_rnd('max(i / 10.0)')} AS last_s FROM s GROUP BY ALL",
)
def series_chunks(spark: SparkSession, sf: str) -> DataFrame:
    cut = S.tumbling_chunks(event_series(spark, sf), rate=10)
    return cut.groupBy("clip", "chunk", "offset_s").agg(
        F.count(F.lit(1)).alias("samples"), rnd(F.max("time_s")).alias("last_s")
    )
