"""Queries opN_<name> of the training-data operators, and their SQL where SQL can express them.

Every query runs over the whole table that it names, with the operator's production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, chat, embdedup, html_text, langid, lm, mixing, quality, simhash, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), mixing.PRODUCTION)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.groups(_read(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexity(_read(spark, sf_dir, "documents"), lm.PRODUCTION)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokens(_read(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_embeddings": op4_embeddings,
    "op5_toxicity": op5_toxicity,
    "op6_lm": op6_lm,
    "op7_html": op7_html,
    "op8_bpe": op8_bpe,
    "op9_language_id": op9_language_id,
    "op10_chat": op10_chat,
}

ORACLE_SQL: dict[str, str] = {
    "op10_chat": chat.ORACLE_SQL,
}
