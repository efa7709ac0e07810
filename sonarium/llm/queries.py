"""Registered queries of this package: each operator with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import sonarium.llm.compression
import sonarium.llm.jpeg
import sonarium.llm.media
import sonarium.llm.near_dups
import sonarium.llm.packing
import sonarium.llm.vector_codes
import sonarium.llm.vectors
import sonarium.llm.warc
import sonarium.llm.whitening
import sonarium.llm.words
from sonarium.llm.chat import CONTROL, END, NEXT, START, chat_digests, format_chats, read_chats
from sonarium.llm.common import table
from sonarium.llm.compression import score_quality
from sonarium.llm.media import text_media
from sonarium.llm.mixing import BLOCK_WORDS, CIRCLE, GOLDEN, mixed_documents
from sonarium.llm.near_dups import near_duplicates
from sonarium.llm.packing import pack_documents
from sonarium.llm.quality import judge
from sonarium.llm.secrets import scan_secrets
from sonarium.llm.shards import shard_documents
from sonarium.llm.url_filter import filter_urls
from sonarium.llm.vector_codes import ENTRIES, FACTOR, PARTS, ROUNDS, compress_vectors
from sonarium.llm.warc import archive_pages
from sonarium.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]

# Python workers may start without this folder on their path: ship the Arrow functions by value.
for _module in (
    sonarium.llm.compression,
    sonarium.llm.jpeg,
    sonarium.llm.media,
    sonarium.llm.near_dups,
    sonarium.llm.packing,
    sonarium.llm.vector_codes,
    sonarium.llm.vectors,
    sonarium.llm.warc,
    sonarium.llm.whitening,
    sonarium.llm.words,
):
    cloudpickle.register_pickle_by_value(_module)

#: The tokenizer file, which every machine has.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: A conversation whose texts look like another template's markers.
ODD_CHAT = "SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)"


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, added=True)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(read_chats(format_chats(turns.unionByName(spark.sql(ODD_CHAT)))))


def op11_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_contour_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_media_jpeg, op2_warc_zstd, op3_near_duplicates, op4_mix_sources, op5_shards, op6_url_filter, op7_quality_rules,
        op8_pack_documents, op9_secret_scan, op10_format_chats, op11_compression_quality, op12_vector_codes, op13_contour_whitening,
    )
}

_ESCAPED = "coalesce({0}, '')"
for _from, _to in (("&", "&amp;"), *((c, ("&lt;" if c[0] == "<" else "&lb;") + c[1:]) for c in CONTROL)):
    _ESCAPED = f"replace({_ESCAPED}, '{_from}', '{_to}')"

SIZE_SQL = r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)"



def _codebook_sql() -> str:
    """The rounds of the vector codes in SQL: every part against every entry, without blocks or shortlists."""
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM k, (SELECT unnest(range({PARTS})) AS p)),
    c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, x.p, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m
    FROM x JOIN c{r} c ON x.p = c.p GROUP BY vec_id, x.p)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT p, m.e AS e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS f FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM x))) AS i) GROUP BY ALL),
    c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT p, e, list(f ORDER BY i) AS c FROM s{r} GROUP BY ALL) n ON n.p = c.p AND n.e = c.e)""")
    steps.append(f"""f AS (SELECT vec_id, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
    l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (vec_id) GROUP BY label),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})""")
    return "WITH " + ",\n    ".join(steps) + """
    SELECT vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN k USING (vec_id) JOIN l ON k.label IS NOT DISTINCT FROM l.label, h"""


ORACLES: dict[str, str] = {
    "op2_warc_zstd": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
    d AS (SELECT page_id, html, first, sha1(html) AS h FROM p JOIN f USING (html))
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
      list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda b:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * g + 1 AS INTEGER), 5) AS INTEGER) >> b) & 31 AS INTEGER) + 1, 1)),
        'string_agg', '')), 'string_agg', '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op3_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), t AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
    SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n""",
    "op4_mix_sources": f"""WITH d AS (SELECT doc_id, source, {SIZE_SQL} AS size, substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
    o AS (SELECT *, row_number() OVER v AS place, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
      sum(weight) OVER () - coalesce(sum(weight) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM w WINDOW v AS (ORDER BY source_size / weight, source NULLS LAST)),
    l AS (SELECT arg_min(CAST(rest AS DOUBLE) / CAST(free AS DOUBLE), place) AS level FROM o WHERE weight * (CAST(rest AS DOUBLE) / CAST(free AS DOUBLE)) <= 3 * source_size),
    t AS (SELECT source, source_size, coalesce(least(weight * level, CAST(3 * source_size AS DOUBLE)), 0) AS target FROM w, l),
    q AS (SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS took,
      coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    b AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, ahead, size, doc_id) AS row FROM q),
    -- the golden-ratio points fall on the sources' parts of the whole
    v AS (SELECT source, target, sum(target) OVER (ORDER BY source NULLS FIRST ROWS UNBOUNDED PRECEDING) / sum(target) OVER () AS high FROM t),
    n AS MATERIALIZED (SELECT source, high, coalesce(lag(high) OVER (ORDER BY high, source NULLS FIRST), 0) AS low, CAST(ceil(floor(target + 0.5) / {BLOCK_WORDS}.0) AS BIGINT) AS need FROM v WHERE target >= 0.5),
    k AS (SELECT slot, CAST((CAST(slot AS HUGEINT) * {GOLDEN}) % {CIRCLE} AS DOUBLE) / CAST({CIRCLE} AS DOUBLE) AS u FROM (SELECT unnest(range((SELECT CAST(sum(need) AS BIGINT) FROM n))) AS slot)),
    z AS MATERIALIZED (SELECT source, need, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM k JOIN n ON u >= low AND (u < high OR high >= 1 - 1e-12)),
    h AS (SELECT source, count(*) AS have FROM z GROUP BY source),
    m AS MATERIALIZED (SELECT source, slot, rank FROM z WHERE rank < need UNION ALL
      SELECT n.source, (SELECT CAST(sum(need) AS BIGINT) FROM n), unnest(range(coalesce(have, 0), need)) FROM n LEFT JOIN h ON n.source IS NOT DISTINCT FROM h.source WHERE coalesce(have, 0) < need),
    e AS (SELECT row, source, ahead + e * source_size AS begins, least(ahead + e * source_size + size, took) AS ends FROM b, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
    p AS (SELECT row, source, unnest(range(CAST(begins // {BLOCK_WORDS} AS BIGINT), CAST((ends - 1) // {BLOCK_WORDS} AS BIGINT) + 1)) AS rank FROM e WHERE begins < ends),
    f AS (SELECT row, min(slot) AS first_slot, count(*) AS slots FROM p JOIN m ON p.source IS NOT DISTINCT FROM m.source AND p.rank = m.rank GROUP BY row)
    SELECT doc_id, size, source_size, target, CAST(list_sum(list_transform([0, 1, 2], lambda e: least(size, greatest(0, took - e * source_size - ahead)))) AS BIGINT) AS taken,
      first_slot, coalesce(slots, 0) AS slots FROM b LEFT JOIN f USING (row)""",
    "op10_format_chats": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
    m AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS begins FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
      coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
      sum(length({_ESCAPED.format("text")})) + sum(begins * ({len(START) + len(END) + 2} + length(replace({_ESCAPED.format("role")}, chr(10), '&nl;'))))
        + (count(*) - sum(begins)) * {len(NEXT)} AS chars FROM m GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op12_vector_codes": _codebook_sql(),
}
