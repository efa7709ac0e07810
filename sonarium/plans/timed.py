"""Segment and attention queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.operators import attention as A
from sonarium.operators import segments as G
from sonarium.operators.series import minmax
from sonarium.plans.registry import query, rnd, spread, sql_rnd, table
from sonarium.plans.signal import SERIES_SQL, event_series
from sonarium.session import settle

# --- segments -----------------------------------------------------------------------------------------------------------
# Frames: 50 per second. One segment starts at each frame, shifted so that the first ones start before 0; lengths follow
# the values and some are negative. The clip "signup" has no valid word at all.


def durations(series: DataFrame) -> DataFrame:
    return series.groupBy("clip").agg((F.count(F.lit(1)) / 50.0).alias("duration"))


def timed_words(series: DataFrame) -> DataFrame:
    start = F.col("i") / 50.0 - 0.05
    return series.select(
        "clip",
        F.col("i").alias("seg"),
        F.when(F.col("clip") == "signup", -1.0).otherwise(start).alias("start"),
        (start + F.col("x") / 4 + 0.2).alias("end"),
        F.concat(F.lit("w"), F.col("i").cast("string")).alias("word"),
    )


SEGMENTS_SQL = f"""{SERIES_SQL}, d AS (SELECT clip, count(*) AS t, count(*) / 50.0 AS duration FROM s GROUP BY clip),
seg AS (SELECT clip, i AS seg, CASE WHEN clip = 'signup' THEN -1.0::DOUBLE ELSE i / 50.0::DOUBLE - 0.05::DOUBLE END AS start,
  i / 50.0::DOUBLE - 0.05::DOUBLE + x / 4 + 0.2::DOUBLE AS "end", 'w' || CAST(i AS VARCHAR) AS word FROM s),
uni AS (SELECT clip, k AS seg, k / m::DOUBLE * duration AS start, (k + 1) / m::DOUBLE * duration AS "end", 'segment_' || CAST(k + 1 AS VARCHAR) AS word
  FROM (SELECT *, CAST(greatest(8, least(32, floor(duration * 2))) AS BIGINT) AS m FROM d), range(32) r(k) WHERE k < m),
fit AS (SELECT z.*, t, greatest(0, least(t - 1, floor(start * (t / duration)))) AS f0, t / duration AS fps FROM ALLSEG z JOIN d USING (clip)),
fit2 AS (SELECT *, greatest(f0 + 1, least(t, floor("end" * fps))) AS f1 FROM fit),
scored AS (SELECT f.clip, f.seg, f.start, f."end", f.word, avg(s.x) AS saliency FROM fit2 f JOIN s ON s.clip = f.clip AND s.i >= f0 AND s.i < f1 GROUP BY ALL)"""
VALID = '(SELECT seg.* FROM seg JOIN d USING (clip) WHERE "end" > start AND start >= 0 AND "end" <= duration)'
WORDS_SQL = SEGMENTS_SQL.replace("ALLSEG", VALID)
UNIFORM_SQL = SEGMENTS_SQL.replace("ALLSEG", "uni")
BOTH_SQL = SEGMENTS_SQL.replace(
    "ALLSEG", f"(SELECT * FROM {VALID} UNION ALL SELECT * FROM uni WHERE clip NOT IN (SELECT clip FROM {VALID}))"
)
SHOWN = f'clip, seg, {sql_rnd("start")} AS start, {sql_rnd(chr(34) + "end" + chr(34))} AS "end", word'


def shown(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("clip", "seg", rnd("start").alias("start"), rnd("end").alias("end"), "word", *[rnd(c, 9).alias(c) for c in extra])


@query("segments_words", f"WITH {WORDS_SQL} SELECT {SHOWN}, {sql_rnd('saliency', 9)} AS saliency FROM scored")
def segments_words(spark: SparkSession, sf: str) -> DataFrame:
    s = settle(event_series(spark, sf))
    return shown(G.score_word_segments(s, timed_words(s), durations(s)), "saliency")


@query("segments_uniform", f"WITH {UNIFORM_SQL} SELECT {SHOWN}, {sql_rnd('saliency', 9)} AS saliency FROM scored")
def segments_uniform(spark: SparkSession, sf: str) -> DataFrame:
    s = settle(event_series(spark, sf))
    return shown(G.score_uniform_segments(s, durations(s)), "saliency")


@query("segments_fallback", f"WITH {BOTH_SQL} SELECT {SHOWN}, {sql_rnd('saliency', 9)} AS saliency FROM scored")
def segments_fallback(spark: SparkSession, sf: str) -> DataFrame:
    s = settle(event_series(spark, sf))
    return shown(G.score_segments(s, timed_words(s), durations(s)), "saliency")


# The scores of the clip "view" are made so small that its intensities come from ranks.
INTENSITY_SQL = f"""{WORDS_SQL}, q AS (SELECT clip, seg, abs(CASE WHEN clip = 'view' THEN saliency * 1e-12 ELSE saliency END) AS a FROM scored),
r AS (SELECT *, max(a) OVER (PARTITION BY clip) AS m, count(*) OVER (PARTITION BY clip) AS n, row_number() OVER (PARTITION BY clip ORDER BY a DESC, seg) - 1 AS rk FROM q),
inten AS (SELECT clip, seg, greatest(0.1::DOUBLE, CASE WHEN m > 1e-9 THEN a / m ELSE 1.0::DOUBLE - rk / n * 0.9::DOUBLE END) AS intensity FROM r)"""


def intensities(spark: SparkSession, sf: str) -> DataFrame:
    s = settle(event_series(spark, sf))
    scored = G.score_word_segments(s, timed_words(s), durations(s))
    faint = F.when(F.col("clip") == "view", F.col("saliency") * 1e-12).otherwise(F.col("saliency"))
    return G.segment_intensity(scored.withColumn("saliency", faint))


@query("segments_intensity", f"WITH {INTENSITY_SQL} SELECT clip, seg, {sql_rnd('intensity')} AS intensity FROM inten")
def segments_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return intensities(spark, sf).select("clip", "seg", rnd("intensity").alias("intensity"))


@query(
    "segments_top",
    f"""WITH {INTENSITY_SQL} SELECT clip, seg, CAST(row_number() OVER (PARTITION BY clip ORDER BY intensity DESC, seg) AS INTEGER) AS rank FROM inten
    QUALIFY row_number() OVER (PARTITION BY clip ORDER BY intensity DESC, seg) <= 5""",
)
def segments_top(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_segments(intensities(spark, sf)).select("clip", "seg", "rank")


@query(
    "segments_share",
    f"""WITH {WORDS_SQL} SELECT clip, seg, {sql_rnd('greatest(0.1::DOUBLE, greatest(0.0::DOUBLE, "end" - start) / greatest(0.001::DOUBLE, duration) * 100)')} AS width_percent
    FROM seg JOIN d USING (clip)""",
)
def segments_share(spark: SparkSession, sf: str) -> DataFrame:
    s = settle(event_series(spark, sf))
    return G.segment_share(timed_words(s), durations(s)).select("clip", "seg", rnd("width_percent").alias("width_percent"))


# The turns of a conversation as timed phrases; some end no later than they start.
@query(
    "segments_word_times",
    f"""WITH p AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS txt, turn * 2.0::DOUBLE AS start, turn * 2.0::DOUBLE + (length(text) % 7)::DOUBLE AS "end" FROM conversations),
    w AS (SELECT *, list_filter(string_split(txt, ' '), lambda x: x <> '') AS ws FROM p),
    e AS (SELECT conv_id, turn, start, "end", CASE WHEN len(ws) <= 1 OR "end" <= start THEN [txt] ELSE ws END AS ws FROM w),
    u AS (SELECT conv_id, turn, start, "end", len(ws) AS m, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS k FROM e)
    SELECT conv_id, turn, CAST(k AS INTEGER) AS piece, word, {sql_rnd('CASE WHEN m = 1 THEN start ELSE start + k * ("end" - start) / m END')} AS start,
      {sql_rnd('CASE WHEN m = 1 THEN "end" ELSE start + (k + 1) * ("end" - start) / m END')} AS "end" FROM u""",
)
def segments_word_times(spark: SparkSession, sf: str) -> DataFrame:
    phrases = spread(table(spark, sf, "conversations")).select(
        "conv_id",
        "turn",
        F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"),
        (F.col("turn") * 2.0).alias("start"),
        (F.col("turn") * 2.0 + F.length("text") % 7).alias("end"),
    )
    timed = G.interpolate_word_times(phrases)
    return timed.select("conv_id", "turn", "piece", "word", rnd("start").alias("start"), rnd("end").alias("end"))


# --- attention ----------------------------------------------------------------------------------------------------------
# The 64 values of an embedding as weights [2 layers][2 heads][4][4]; the turns of the conversation of the same number as
# the clip's words, so a clip can have more words than positions.


def attention(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")

    def cell(at):
        return F.abs(F.get(e, at).cast("double"))

    four = F.sequence(F.lit(0), F.lit(3))
    two = F.sequence(F.lit(0), F.lit(1))
    nested = F.transform(
        two,
        lambda l: F.transform(
            two, lambda h: F.transform(four, lambda i: F.transform(four, lambda j: cell(l * 32 + h * 16 + i * 4 + j)))
        ),
    )
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip"), nested.alias("attention"))


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """One head per clip, picked inside the row before anything is exploded."""
    picked = A.pick_head_nested(attention(spark, sf), "attention", layer=1, head=5)
    rows = picked.select("clip", F.posexplode("attention").alias("i", "_r"))
    return rows.select("clip", "i", F.posexplode("_r").alias("j", "w"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("turn") * 1.5
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("clip"),
        F.col("turn").alias("idx"),
        F.concat_ws("_", "role", F.length("text").cast("string")).alias("word"),
        start.alias("start"),
        (start + (F.length("text") % 10 + 1) / 10.0).alias("end"),
    )


CELLS_SQL = """cells AS (SELECT vec_id AS clip, CAST(k // 32 AS INTEGER) AS layer, CAST(k // 16 % 2 AS INTEGER) AS head, CAST(k // 4 % 4 AS INTEGER) AS i, CAST(k % 4 AS INTEGER) AS j,
  abs(embedding[k + 1]::DOUBLE) AS w FROM embeddings, range(64) r(k)),
m AS (SELECT clip, i, j, w FROM cells WHERE layer = 1 AND head = 0),
words AS (SELECT conv_id AS clip, turn AS idx, role || '_' || CAST(length(text) AS VARCHAR) AS word, turn * 1.5::DOUBLE AS start,
  turn * 1.5::DOUBLE + (length(text) % 10 + 1) / 10.0::DOUBLE AS "end" FROM conversations),
pairs AS (SELECT a.clip, a.idx AS from_index, b.idx AS to_index, a.word AS from_word, b.word AS to_word, a.start AS from_start, a."end" AS from_end,
  b.start AS to_start, b."end" AS to_end, w AS attention_weight FROM words a JOIN words b ON a.clip = b.clip JOIN m ON m.clip = a.clip AND m.i = least(a.idx, 3) AND m.j = least(b.idx, 3))"""


@query("attention_explode", f"WITH {CELLS_SQL} SELECT clip, layer, head, i, j, {sql_rnd('w', 9)} AS w FROM cells")
def attention_explode(spark: SparkSession, sf: str) -> DataFrame:
    return A.explode_attention(attention(spark, sf)).withColumn("w", rnd("w", 9))


@query(
    "attention_truncate",
    f"WITH {CELLS_SQL} SELECT clip, count(*) AS cells, {sql_rnd('sum(w)')} AS total FROM cells WHERE head < 1 AND i < 3 AND j < 3 GROUP BY clip",
)
def attention_truncate(spark: SparkSession, sf: str) -> DataFrame:
    cut = A.truncate_attention(A.explode_attention(attention(spark, sf)), heads=1, positions=3)
    return cut.groupBy("clip").agg(F.count(F.lit(1)).alias("cells"), rnd(F.sum("w")).alias("total"))


@query("attention_pick_head", f"WITH {CELLS_SQL} SELECT clip, i, j, {sql_rnd('w', 9)} AS w FROM m")
def attention_pick_head(spark: SparkSession, sf: str) -> DataFrame:
    picked = A.pick_head(A.explode_attention(attention(spark, sf)), layer=1, head=5)
    return picked.withColumn("w", rnd("w", 9))


@query(
    "attention_pick_head_nested",
    f"WITH {CELLS_SQL} SELECT clip, i, j, {sql_rnd('w', 9)} AS w FROM cells WHERE layer = 0 AND head = 1",
)
def attention_pick_head_nested(spark: SparkSession, sf: str) -> DataFrame:
    picked = A.pick_head_nested(attention(spark, sf), "attention", layer=6, head=1)
    rows = picked.select("clip", F.posexplode("attention").alias("i", "_r"))
    return rows.select("clip", "i", F.posexplode("_r").alias("j", "w")).withColumn("w", rnd("w", 9))


@query(
    "attention_pairs",
    f"WITH {CELLS_SQL} SELECT * EXCLUDE (attention_weight), {sql_rnd('attention_weight', 9)} AS attention_weight FROM pairs",
)
def attention_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return A.attention_pairs(chunks(spark, sf), matrix(spark, sf)).withColumn("attention_weight", rnd("attention_weight", 9))


TIMELINE_SQL = f"""{CELLS_SQL}, rs AS (SELECT clip, i, max(w) AS mo, sum(w) AS s, count(*) AS len, max(CASE WHEN i = j THEN w END) AS self FROM m GROUP BY clip, i),
en AS (SELECT clip, i, -sum(w / s * ln(w / s + 1e-10)) AS ent FROM m JOIN rs USING (clip, i) WHERE s > 0 GROUP BY clip, i),
cs AS (SELECT clip, j AS i, sum(w) / 4 AS inc FROM m GROUP BY clip, j),
dur AS (SELECT clip, arg_max("end", idx) AS d FROM words GROUP BY clip),
grid AS (SELECT clip, d, unnest(range(CAST(ceil(d / 0.1::DOUBLE) AS BIGINT))) AS point FROM dur),
tl AS (SELECT g.clip, point, point * 0.1::DOUBLE AS time, CAST(least(floor(point * 0.1::DOUBLE / d * 4), 3) AS BIGINT) AS frame_index FROM grid g),
tm AS (SELECT t.*, mo AS max_outgoing, inc AS avg_incoming, self AS self_attention, coalesce(ent / ln(len), 0) AS attention_entropy, coalesce(mo * (0.7 + 0.3 * coalesce(ent / ln(len), 0)), 0) AS attention
  FROM tl t LEFT JOIN rs ON rs.clip = t.clip AND rs.i = frame_index LEFT JOIN en ON en.clip = t.clip AND en.i = frame_index LEFT JOIN cs ON cs.clip = t.clip AND cs.i = frame_index)"""
MEASURES = ("time", "max_outgoing", "avg_incoming", "self_attention", "attention_entropy", "attention")


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return A.attention_timeline(chunks(spark, sf), matrix(spark, sf))


@query(
    "attention_timeline",
    f"WITH {TIMELINE_SQL} SELECT clip, point, frame_index, {', '.join(f'{sql_rnd(c)} AS {c}' for c in MEASURES)} FROM tm",
)
def attention_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return timeline(spark, sf).select("clip", "point", "frame_index", *[rnd(c).alias(c) for c in MEASURES])


@query(
    "attention_timeline_stats",
    f"""WITH {TIMELINE_SQL} SELECT clip, {sql_rnd('min(attention)')} AS min, {sql_rnd('max(attention)')} AS max, {sql_rnd('max(attention) - min(attention)')} AS range,
      count(*) AS points, {sql_rnd('max(d) / count(*) * 1000')} AS resolution_ms FROM tm JOIN dur USING (clip) GROUP BY clip""",
)
def attention_timeline_stats(spark: SparkSession, sf: str) -> DataFrame:
    ends = chunks(spark, sf).groupBy("clip").agg(F.max_by("end", "idx").alias("duration"))
    stats = A.timeline_stats(timeline(spark, sf), ends)
    return stats.select("clip", "points", *[rnd(c).alias(c) for c in ("min", "max", "range", "resolution_ms")])


@query(
    "attention_timeline_peaks",
    f"""WITH {TIMELINE_SQL}, k AS (SELECT clip, avg(attention) AS a, stddev_pop(attention) AS sd FROM tm GROUP BY clip)
    SELECT clip, point, attention > a + sd AS is_peak FROM tm JOIN k USING (clip)""",
)
def attention_timeline_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return A.timeline_peaks(timeline(spark, sf)).select("clip", "point", "is_peak")


@query(
    "attention_timeline_curve",
    f"""WITH {TIMELINE_SQL}, k AS (SELECT clip, point, attention AS a, min(attention) OVER (PARTITION BY clip) AS lo, max(attention) OVER (PARTITION BY clip) AS hi FROM tm)
    SELECT clip, point, {sql_rnd('(a - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END')} AS height FROM k""",
)
def attention_timeline_curve(spark: SparkSession, sf: str) -> DataFrame:
    line = timeline(spark, sf).select("clip", F.col("point").alias("i"), F.col("attention").alias("x"))
    return minmax(line, "timeline").select("clip", F.col("i").alias("point"), rnd("x").alias("height"))


@query(
    "attention_matrix",
    f"""WITH {CELLS_SQL}, kept AS (SELECT * FROM pairs WHERE from_index <= to_index), b AS (SELECT clip, max(greatest(from_index, to_index)) AS mx FROM kept GROUP BY clip)
    SELECT b.clip, f.i AS from_index, t.i AS to_index, {sql_rnd('coalesce(attention_weight, 0)', 9)} AS w FROM b, range(8) f(i), range(8) t(i)
    LEFT JOIN kept k ON k.clip = b.clip AND k.from_index = f.i AND k.to_index = t.i WHERE f.i <= mx AND t.i <= mx""",
)
def attention_matrix(spark: SparkSession, sf: str) -> DataFrame:
    pairs = A.attention_pairs(chunks(spark, sf), matrix(spark, sf)).filter("from_index <= to_index")
    return A.attention_matrix(pairs).withColumn("w", rnd("w", 9))


#: Columns of the grid in SQL, which cannot take them from the table; with longer conversations the schemas differ.
TURNS = 8


@query(
    "attention_grid",
    f"""WITH {CELLS_SQL} SELECT clip, from_index, {', '.join(sql_rnd(f"coalesce(max(attention_weight) FILTER (to_index = {k}), 0)", 9) + f' AS to_{k}' for k in range(TURNS))} FROM pairs GROUP BY clip, from_index""",
)
def attention_grid(spark: SparkSession, sf: str) -> DataFrame:
    pairs = A.attention_pairs(chunks(spark, sf), matrix(spark, sf))
    longest = table(spark, sf, "conversations").agg(F.max("turn")).first()[0]
    shown = range(0 if longest is None else longest + 1)
    grid = A.attention_grid(pairs, shown)
    return grid.select("clip", "from_index", *[rnd(f"to_{k}", 9).alias(f"to_{k}") for k in shown])


@query(
    "attention_top_pairs",
    f"""WITH {CELLS_SQL} SELECT clip, from_index, to_index, CAST(row_number() OVER w AS INTEGER) AS rank, {sql_rnd('attention_weight', 9)} AS attention_weight
    FROM pairs WHERE from_index <> to_index WINDOW w AS (PARTITION BY clip ORDER BY attention_weight DESC, from_index, to_index) QUALIFY row_number() OVER w <= 10""",
)
def attention_top_pairs(spark: SparkSession, sf: str) -> DataFrame:
    top = A.top_pairs(A.attention_pairs(chunks(spark, sf), matrix(spark, sf)))
    return top.select("clip", "from_index", "to_index", "rank", rnd("attention_weight", 9).alias("attention_weight"))


@query(
    "attention_pair_intensity",
    f"""WITH {CELLS_SQL}, p AS (SELECT *, attention_weight * 6 AS a FROM pairs), r AS (SELECT *, max(CASE WHEN from_index <> to_index AND a > 0 THEN a END) OVER (PARTITION BY clip) AS hi FROM p)
    SELECT clip, from_index, to_index, {sql_rnd('CASE WHEN from_index = to_index THEN 0.8 ELSE greatest(0.1, a / greatest(coalesce(hi, 1), 1)) END', 9)} AS intensity FROM r""",
)
def attention_pair_intensity(spark: SparkSession, sf: str) -> DataFrame:
    pairs = A.attention_pairs(chunks(spark, sf), matrix(spark, sf))
    shown_pairs = A.pair_intensity(pairs.withColumn("attention_weight", F.col("attention_weight") * 6))
    return shown_pairs.select("clip", "from_index", "to_index", rnd("intensity", 9).alias("intensity"))
