"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldsense.llm import (bpe, conversations, exact_dedup, html_extract, langid, licenses, lz, mix, quality, shard,
                            simhash, token_counts, whitening)
from fieldsense.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


@register("op1_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


@register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


@register("op3_lz_fingerprint")
def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.lz_report(read_table(spark, sf_dir, "documents"))


@register("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(read_table(spark, sf_dir, "documents"))


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(read_table(spark, sf_dir, "documents"))


@register("op6_mix_sources", r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), c AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits,
         CAST(floor((CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
               / 4503599627370496.0) * 256) AS INTEGER) AS bucket
  FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bits * 64 + (size >> greatest(bits - 5, 0)), bucket,
                               doc_id NULLS LAST, size) AS rnk
  FROM c
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS i FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][(i - 1) % 3 + 1] AS weight, 2.0 * source_size AS cap FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5
             - coalesce(sum(CAST(cap AS DOUBLE)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / ((SELECT sum(weight) FROM w)
             - coalesce(sum(CAST(weight AS DOUBLE)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT max(lev) FROM l) * CAST(weight AS DOUBLE)) AS target,
         CAST('0x' || substr(md5('offset 42|' || coalesce(source, 'null')), 1, 13) AS BIGINT)
           / 4503599627370496.0 AS off
  FROM l
), x AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
)
SELECT r.doc_id, r.size, x.source_size, x.target,
       CAST(least(floor(x.off + x.rate * r.rnk) - floor(x.off + x.rate * (r.rnk - 1)), ceil(x.rate)) AS BIGINT)
         * r.size AS taken
FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source
""")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_report(read_table(spark, sf_dir, "documents"))


@register("op7_html_extract")
def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main(read_table(spark, sf_dir, "pages"))


@register("op8_license_scan", licenses.sql())
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


@register("op9_byte_shards")
def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.byte_shards(read_table(spark, sf_dir, "documents"))


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(read_table(spark, sf_dir, "documents"))


@register("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return conversations.repair_report(conversations.damaged(rows), rows.select("conv_id"))


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@register("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
