"""Message tables: conversations and documents in the shape that every operator reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.units import utf16_length

__all__ = ["ORIGINAL", "from_conversations", "from_documents", "renumbered", "utf16_length", "validate"]

#: Where a compressed message comes from: the ids that it stands for, its own id as a summary, those of its parts, a version.
ORIGINAL = "struct<ids:array<string>,summary_id:string,parent_ids:array<string>,version:bigint>"


def from_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id, role, content, tool_calls) with positions from 0 in turn order.

    Ids are unique: the second row of a turn has ``-2`` at the end of its id, and so on.
    """
    again = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    named = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("pos"),
        F.when(again > 1, F.concat_ws("-", named, again.cast("string"))).otherwise(named).alias("id"),
        "role",
        F.col("text").alias("content"),
        F.lit(None).cast("array<string>").alias("tool_calls"),
    )


def from_documents(docs: DataFrame, span: int = 1000) -> DataFrame:
    """Documents as messages: a conversation is a source's documents of ``span`` ids in a row, so that none grows with the table."""
    conv = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.coalesce("doc_id", F.lit(0)) / span).cast("string"))
    order = Window.partitionBy("conv_id").orderBy("doc_id", "text")
    return docs.select(conv.alias("conv_id"), "doc_id", "text").select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("pos"),
        F.col("doc_id").cast("string").alias("id"),
        F.lit("user").alias("role"),
        F.col("text").alias("content"),
        F.lit(None).cast("array<string>").alias("tool_calls"),
    )


def renumbered(messages: DataFrame) -> DataFrame:
    """Messages with positions from 0 again, as after a compression."""
    return messages.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1)


def validate(messages: DataFrame) -> DataFrame:
    """Raise, when the plan runs, on a message without an id."""
    return messages.withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.lit("every message needs an id"))).otherwise(F.col("id")))
