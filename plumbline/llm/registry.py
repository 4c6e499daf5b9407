"""The numbered queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    decontamination, embedding_dedup, flow_sharding, hmm_lm, html_crf, line_templates, model_sql, quality_fm, sentencepiece_lattice, simhash, spelling, url_filter, vector_codes, warc_store,
)
from plumbline.llm.common import new_dir, table

URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
OLD_SHARDS, SHARDS = 12, 16


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_crf.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_fm.train(docs, labels.filter(~quality_fm.held_out(F.col("doc_id"))))
    return quality_fm.score(docs.select("doc_id", "text", "n_chars"), model).select(
        "doc_id",
        quality_fm.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece_lattice.encode_and_check(docs, sentencepiece_lattice.default_pieces(spark))
    return encoded.select("doc_id", "ids", F.size("ids").alias("n_ids"), "round_trip")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leak_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    warc_store.write_archive(table(spark, sf_dir, "pages"), path, "page_id", "url", payload)
    return warc_store.read_records(spark, path).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")
    layout = flow_sharding.write_layout(table(spark, sf_dir, "documents").select("doc_id", "text", old.alias("old_shard")), "old_shard")
    size, crc = flow_sharding.text_size(F.col("text")), flow_sharding.text_crc32(F.col("text"))
    narrow = layout.select("row_id", "doc_id", size.alias("size"), crc.alias("text_crc32"), "old_shard")
    plan = flow_sharding.reshard(narrow, "old_shard", "size", ["doc_id", "text_crc32", "size"], SHARDS)
    placed = flow_sharding.rewrite_shards(layout, plan, "old_shard")
    return placed.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.language_scores(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_quality": op3_quality,
        "op4_line_dedup": op4_line_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_decontamination": op6_decontamination,
        "op7_warc": op7_warc,
        "op8_sharding": op8_sharding,
        "op9_url_filter": op9_url_filter,
        "op10_simhash": op10_simhash,
        "op11_vector_codes": op11_vector_codes,
        "op12_language_model": op12_language_model,
        "op13_spelling_variants": op13_spelling_variants,
    }


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, sha256(html) AS k FROM p),
w AS (SELECT k, max(page_id) AS holder FROM d GROUP BY k)
SELECT page_id, payload_bytes,
  translate(
    to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8) ||
    to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM d JOIN w USING (k)
"""

OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""


OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND list_sum(list_transform(v, lambda x: x * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(w.b) FROM walk w WHERE w.a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(w.b) FROM walk w WHERE w.a = e.vec_id), e.vec_id)) AS kept
FROM e
"""


def oracle_sql() -> dict:
    return {
        "op2_embedding_dedup": OP2_SQL,
        "op7_warc": OP7_SQL,
        "op9_url_filter": OP9_SQL,
        "op11_vector_codes": model_sql.vector_codes_sql(vector_codes.ROUNDS),
        "op13_spelling_variants": model_sql.SPELLING_SQL,
    }
