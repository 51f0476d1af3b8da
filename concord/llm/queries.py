"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import embedding_dedup, html_text, language, licenses, line_dedup, media, mixing, packing, simhash, token_counts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), words=3, budget=3)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store_texts(_documents(spark, sf_dir)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_documents(spark, sf_dir), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("text_hash", "slots")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json")).drop("ids")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.train(docs, vocabulary("piece_bpe_32k.model"))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", (~language.learnable()).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), limit=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_media, op3_license_scan, op4_line_dedup, op5_embedding_dedup, op6_mixing, op7_packing, op8_html_text, op9_language, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4, "op6_mixing": OP6}


OP4 = r"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), exploded AS (
  SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM lines
), keyed AS (
  SELECT r, doc_id, line, p,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM exploded
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT a.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN a.line END, chr(10) ORDER BY a.p), '')) AS kept_sha256
FROM keyed a LEFT JOIN frequent f ON a.k = f.k
GROUP BY a.r, a.doc_id
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|17') AS o
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s
), lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM w
), f AS (
  SELECT *, (SELECT level FROM lev WHERE cap / w > level ORDER BY cap / w, k LIMIT 1) AS final FROM lev
), t AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), final * w) END AS target FROM f
), b AS (
  SELECT t.*, CAST(round(target) AS BIGINT) AS goal, greatest(source_size, 1) AS s1,
    greatest(1, least(4096, (SELECT CAST(sum(source_size) AS BIGINT) >> 18 FROM t))) AS block, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM t
), n AS (
  SELECT *, goal // s1 * ((s1 + block - 1) // block) + (goal % s1 + block - 1) // block AS need FROM b
), c AS (
  SELECT k, need, CAST(sum(need + 128) OVER () AS BIGINT) AS slots, max(k) OVER () AS last,
    CAST(floor(CAST(sum(need + 128) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(need + 128) OVER () AS DOUBLE) * 2147483648) AS BIGINT) AS hi
  FROM n WHERE need > 0
), i AS (
  SELECT k, need, slots, coalesce(lag(hi) OVER (ORDER BY k), 0) AS lo, CASE WHEN k = last THEN 2147483648 ELSE hi END AS hi FROM c
), points AS (
  SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range((SELECT max(slots) FROM c))) AS slot)
), ranked AS (
  SELECT k, slot, need, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM points JOIN i ON point >= lo AND point < hi
), p AS (
  SELECT d.doc_id, d.size, n.k, n.source_size, n.target, n.goal, n.block, n.need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS a
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(size, goal % source_size - a)) END AS BIGINT) AS taken,
  CASE WHEN size > 0 THEN slot END AS first_slot
FROM p LEFT JOIN ranked ON p.k = ranked.k AND p.a // p.block = ranked.rank AND ranked.rank < ranked.need
"""
