"""One query per operator, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import (
    chat_format, decontamination, exact_dedup, hard_negatives, html_text, language, mixing, near_join, pii, prefix_trie,
    sharding, url_lists, warc_zip)
from weftgraph.llm.common import table


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op4_crf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.text_report(table(spark, sf_dir, "pages"))


def op5_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.url_report(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.jaccard_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_report(chat_format.with_probe(spark, table(spark, sf_dir, "conversations")))


REGISTRY = {f.__name__: f for f in (
    op1_bm25_decontamination, op2_weak_pii, op3_rank_order_language, op4_crf_html, op5_zip_warc,
    op6_temporal_url_lists, op7_exact_dedup, op8_mix_sources, op9_minimax_shards, op10_token_group_jaccard,
    op11_prefix_trie, op12_segment_negatives, op13_reply_trees)}
ORACLES = {"op5_zip_warc": warc_zip.ORACLE, "op6_temporal_url_lists": url_lists.ORACLE,
           "op7_exact_dedup": exact_dedup.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE,
           "op12_segment_negatives": hard_negatives.ORACLE, "op13_reply_trees": chat_format.ORACLE}
