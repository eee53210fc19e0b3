"""One query per text operator, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, hashing, lines, ngram_join, pii, quality, ranked, repair, spans, suffix, urls
from .common import table

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_pages(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_columns(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(table(spark, sf_dir, "documents"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.every_hundredth(table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op9_chat, op10_urls, op8_decontamination, op3_ngram_join, op4_sentence_spans, op2_quality, op5_line_dedup, op6_pii, op7_suffix, op11_ranked, op12_hashing, op13_repair)
}
ORACLES: dict[str, str] = {"op5_line_dedup": lines.SQL, "op4_sentence_spans": spans.SQL, "op3_ngram_join": ngram_join.SQL, "op9_chat": chat.SQL, "op10_urls": urls.SQL, "op11_ranked": ranked.SQL, "op13_repair": repair.SQL}
