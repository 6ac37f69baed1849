"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fingerprints, html_extract, lines, pieces, simhash, token_files, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; the files aren't part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op1(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2(table(spark, sf_dir, "conversations"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op4(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op5(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op6(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op7(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op9(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op10(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_files": op1_token_files,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_decontamination": op3_decontamination,
    "op4_html_extraction": op4_html_extraction,
    "op5_fingerprints": op5_fingerprints,
    "op6_url_filters": op6_url_filters,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op10_line_dedup": lines.ORACLE,
}
