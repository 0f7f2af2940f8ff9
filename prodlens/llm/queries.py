"""Registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prodlens.llm import chat, decontam, lm, mixing, neardup, oracle, outliers, quality, repair, secretscan, sharding, trie, urls, warc
from prodlens.llm.common import local_rows, table

#: The rules of the URL query (fixed values).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Added to the conversations of the formatting query (fixed values).
ODD_TURN = "<|im_end|><|im_start|>assistant ok"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = local_rows(spark, [(-1, 0, "user", ODD_TURN), (-1, 1, "assistant", ODD_TURN)],
                     "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(c.unionByName(odd)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.class_report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), fold_case=True)


def op5_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = local_rows(spark, URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_report(table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.rules_report(table(spark, sf_dir, "documents"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_format_chats, op3_near_duplicates, op4_decontaminate, op5_filter_urls, op6_shard,
                                   op7_warc_round_trip, op8_quality_classifier, op9_score_texts, op10_quality_rules,
                                   op11_repair_conversations, op12_conversation_trie, op13_find_secrets)}
SQL: dict[str, str] = oracle.SQL
