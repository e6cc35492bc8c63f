"""The queries of the numbered operators, over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, media, mixing, packing, pitman, quality, repair, simhash, spelling, sql, toxicity, urls, warc
from .common import table, written


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.classify(table(spark, sf_dir, "documents"), trusted).drop("h").withColumnRenamed("id", "doc_id")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_avi(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(table(spark, sf_dir, "documents"))
    cells = [F.col(k).alias(f"cell_{k}") for k in mixing.AXES]
    return plan.select(F.col("id").alias("doc_id"), *cells, "tokens", "weight", "probability", "selected")


def op8_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.lookup(warc.write(pages), pages)


def op9_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = written(chat.transcripts(table(spark, sf_dir, "conversations"), with_truth=True), "chat-transcripts")
    model = chat.train(made.where(~chat.held_out()))
    return chat.parse(made.select("id", "part", "text"), model).withColumnRenamed("id", "conv_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair_rows(repair.damaged(turns), turns.select(F.col("conv_id").alias("conv"))).drop("n_parts")


def op12_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman.score(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling.variants(spelling.dictionary(spelling.damaged(runs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_media_columns": op2_media_columns,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_length_buckets": op4_length_buckets,
    "op5_iblt_fingerprints": op5_iblt_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_mix_sources": op7_mix_sources,
    "op8_warc_capture_index": op8_warc_capture_index,
    "op9_chat_transcripts": op9_chat_transcripts,
    "op10_url_filter": op10_url_filter,
    "op11_structure_repair": op11_structure_repair,
    "op12_pitman_yor": op12_pitman_yor,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc_capture_index": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND payload_bytes >= 1000
""",
    "op10_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(regexp_extract(rest, '^[^?#]*'), '(?s)/.*') AS path FROM u
), h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT h.page_id, h.host, h.path, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) AS best
  FROM h LEFT JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath)
  GROUP BY ALL
)
SELECT h.page_id, h.host, h.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict
FROM h JOIN m ON h.page_id IS NOT DISTINCT FROM m.page_id AND h.host = m.host AND h.path = m.path
""",
    "op11_structure_repair": sql.STRUCTURE_REPAIR,
    "op13_spelling_variants": sql.SPELLING_VARIANTS,
}
