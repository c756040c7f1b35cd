"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing, tokens.

Each stage reads all rows that the stage before it kept. The first four return the columns of ``documents``; the last
returns the tokens of each document with the check that decoding them gives the text again.

Models are trained on a bounded sample of labelled rows of the stage's own input (see the operators' parameters). Rows
with a null text have no language, so the first stage drops them. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, langid, mixing, simhash, toxicity
from weftline.runtime import discard, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return langid.accepted(docs, langid.fit(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic sentence."""
    return toxicity.clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' target weights, shard after shard."""
    return mixing.mixed(docs, mixing.PRODUCTION)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return bpe.tokens(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("byte_bpe", encoding),
]

#: The stages train models and fold merges, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are in Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: str | None = None
    for name, stage in STAGES[:-1]:
        at = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            discard(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
