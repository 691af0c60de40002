"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, lattice, mixing, packing, quality, sharding, simhash, toxicity, urls, warc
from .common import crc_mod, delete_at_exit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.links(table(spark, sf_dir, "embeddings"), 0.98)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    found = lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), held_out)
    return found.withColumnRenamed("id", "doc_id")


def op4_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, table(spark, sf_dir, "labels"), learn=toxicity.not_held_out(), keep=["doc_id"])
    return found.select("doc.doc_id", (crc_mod("doc.doc_id", 3) == 1).alias("held_out"), "score", "predicted")


#: The listed URLs of op6: host, path and verdict.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op6_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(LISTED, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), listed).withColumnRenamed("id", "page_id")


OP6_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT host, path, max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, verdict := verdict)) AS best
  FROM (SELECT DISTINCT host, path FROM p) d JOIN r
    ON (d.host = rhost OR ends_with(d.host, '.' || rhost)) AND starts_with(d.path, rpath)
  GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits USING (host, path)
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    delete_at_exit(spark, path)  # the result is read from the archives
    return warc.pages_of(warc.read(spark, path)).withColumnRenamed("id", "page_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.judge(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    # the digest is of the ids as they were packed
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT reach.i, p.j FROM reach JOIN p ON reach.j = p.i
), c AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i), n AS (SELECT i, count(*) AS n FROM p GROUP BY i)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.i = vec_id LEFT JOIN n ON n.i = vec_id
"""

OP7_SQL = """
WITH b AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest, unhex(sha1(payload))::BIT::VARCHAR AS bits FROM b
), t AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
    + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM t
"""

QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_embedding_near_dedup, op3_subword_lattice, op4_karmarkar_karp_sharding, op5_kneser_ney_toxicity, op6_bloom_url_filter, op7_warc, op8_quality_rules, op9_mixing, op10_packing)}
ORACLES: dict[str, str] = {"op2_embedding_near_dedup": OP2_SQL, "op7_warc": OP7_SQL, "op6_bloom_url_filter": OP6_SQL}
