"""Arriving messages: what the rules say of each by itself, and tokens of conversations in windows of time.

Both are plain stream transformations. Rules that look at other messages, and compression itself, need a conversation as
a whole: ``compress_batches`` runs them on every micro-batch of whole conversations and publishes the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weftline.operators.compress import compress
from weftline.operators.decisions import features
from weftline.operators.options import CompressOptions
from weftline.sources.messages import from_conversations
from weftline.sources.store import publish


def sifted(stream: DataFrame, options: CompressOptions = CompressOptions()) -> DataFrame:
    """(conv_id, id, role, chars, tokens, verdict) of messages (conv_id, pos, id, role, content, tool_calls), stateless.

    ``verdict`` is the first rule that holds whatever the other messages are; null for what may be compressed.
    """
    df = features(stream, options)
    verdict = (
        F.when(F.col("_role"), "preserved_role")
        .when(F.col("_called"), "tool_calls")
        .when(F.col("_done"), "already_compressed")
        .when(~F.col("_large") & (F.col("_size") < options.short_chars), "short_content")
        .when(F.col("_prose").isNotNull(), F.when(F.col("_prose") >= 80, "code_split").otherwise("code_fence_no_prose"))
        .when(F.col("_hard") != "", F.concat(F.lit("hard_t0:"), "_hard"))
        .when(F.col("_pattern").isNotNull(), F.concat(F.lit("pattern:"), "_pattern"))
        .when(F.col("_json"), "json_structure")
    )
    return df.select("conv_id", "id", "role", F.col("_size").alias("chars"), F.col("_tokens").alias("tokens"), verdict.alias("verdict"))


def token_windows(stream: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes", options: CompressOptions = CompressOptions()) -> DataFrame:
    """(conv_id, start, messages, tokens): counts of each conversation in tumbling windows; rows more than ``late`` behind are dropped.

    State is kept only as long as a window may still change. Rows without a time are dropped.
    """
    timed = stream.withWatermark(time, late)
    counted = timed.groupBy(F.window(time, window).alias("w"), "conv_id").agg(F.count("*").alias("messages"), F.sum(options.token_counter(F.col("content")).cast("long")).alias("tokens"))
    return counted.select("conv_id", F.col("w.start").alias("start"), "messages", "tokens")


def compress_batches(turns: DataFrame, path: str, options: CompressOptions = CompressOptions()) -> DataStreamWriter:
    """A writer that compresses each micro-batch of whole conversations (conv_id, turn, role, text) and publishes it under ``path``/batch-N.

    A batch that is run again after a failure writes a publication of its own and takes the place of the first: readers
    see one of the two, never a mixture.
    """

    def step(batch: DataFrame, number: int) -> None:
        publish(compress(from_conversations(batch), options), f"{path}/batch-{number}", keep_history=False)

    return turns.writeStream.foreachBatch(step)
