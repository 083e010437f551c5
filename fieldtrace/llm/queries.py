"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, fill_middle, licenses, lines, media, mixing, oracles, packing, passages, shards, simhash, suffixes, toxicity, warc
from .common import table


def op1_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.gif_digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_rules(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.substring_removal(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_digests(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_repairs(table(spark, sf_dir, "conversations"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gif": op1_gif,
    "op2_simhash": op2_simhash,
    "op3_passages": op3_passages,
    "op4_line_rules": op4_line_rules,
    "op5_mixing": op5_mixing,
    "op6_suffixes": op6_suffixes,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
    "op11_fill_middle": op11_fill_middle,
    "op12_conversations": op12_conversations,
    "op13_shards": op13_shards,
}

ORACLES: dict[str, str] = {
    "op11_fill_middle": oracles.FILL_MIDDLE,
    "op12_conversations": oracles.CONVERSATIONS,
    "op13_shards": oracles.SHARDS,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
        SELECT page_id, payload_bytes, d.payload_digest,
               CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id THEN first END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
    """,
}
