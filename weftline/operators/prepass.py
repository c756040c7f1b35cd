"""Trimming of tool messages before compression: verbose output, echoes of the assistant, reads that a later write made stale.

Only contents change; what is cut is gone (``restore`` gives the trimmed text). Roles ``tool`` and ``function`` are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import tool_noise as N
from weftline.functions.kernels import size
from weftline.functions.patterns import ascii_edges
from weftline.functions.units import utf16_length
from weftline.runtime import ship

ROLES = ("function", "tool")
FILE = r"(?:/[\w.-]+){3,}\.\w{2,5}"
WROTE = r"(?i)\<(?:created|edited|modified|overwritten|replaced|saved|updated|written|wrote)\>"
AHEAD = 15
READ_CHARS = 2000
RECENT = 3


def expired_reads(messages: DataFrame) -> DataFrame:
    """(conv_id, pos) of long tool messages whose file a message among the next 15 writes.

    Files are those of the message's first 800 characters and of the message before it; messages meet by file.
    """
    text = F.coalesce("content", F.lit(""))
    files = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(FILE), F.lit(0)))
    before = F.coalesce(F.lag("content").over(Window.partitionBy("conv_id").orderBy("pos")), F.lit(""))
    tool = F.coalesce("role", F.lit("")).isin(*ROLES) & (utf16_length(text) >= READ_CHARS)
    rows = messages.select("conv_id", "pos", F.when(tool, files(F.concat(before, F.lit("\n"), F.substring(text, 1, 800)))).alias("read"), F.when(text.rlike(ascii_edges(WROTE)), files(text)).alias("wrote"))
    reads = rows.select("conv_id", "pos", F.explode("read").alias("file"))
    writes = rows.select("conv_id", F.col("pos").alias("later"), F.explode("wrote").alias("file"))
    return reads.join(writes, ["conv_id", "file"]).where((F.col("later") > F.col("pos")) & (F.col("later") <= F.col("pos") + AHEAD)).select("conv_id", "pos").distinct()


def _context(messages: DataFrame) -> DataFrame:
    """(conv_id, pos, context) of tool messages: the last three assistant messages before each, newest first."""
    order = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    said = F.coalesce((F.col("role") == "assistant") & F.col("content").isNotNull(), F.lit(False))
    counted = messages.select("conv_id", "pos", "role", "content", said.alias("said")).withColumn("k", F.sum(F.when(F.col("said"), 1).otherwise(0)).over(order))
    tools = counted.where(F.col("role").isin(*ROLES) & (utf16_length(F.col("content")) >= N.ECHO_CHARS)).select("conv_id", "pos", F.explode(F.array(*[F.struct((F.col("k") - i).alias("k"), F.lit(i).alias("back")) for i in range(RECENT)])).alias("x"))
    spoken = counted.where("said").select("conv_id", "k", F.col("content").alias("text"))
    found = tools.select("conv_id", "pos", "x.k", "x.back").join(spoken, ["conv_id", "k"])
    return found.groupBy("conv_id", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("back", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("context"))


def _trimmed(texts: pa.Array, contexts: pa.Array) -> pa.Array:
    out = []
    for text, context in zip(texts.to_pylist(), contexts.to_pylist()):
        if not text:
            out.append(None)
            continue
        short = N.trim_verbose(text)
        done = N.trim_echoes(short, context or "")
        # The echo counts where the text as it came has one, whether or not trimming took it before.
        out.append({"text": done, "verbose": short != text, "echo": done != text and N.trim_echoes(text, context or "") != text, "removed": size(text) - size(done)})
    return pa.array(out, pa.struct([("text", pa.string()), ("verbose", pa.bool_()), ("echo", pa.bool_()), ("removed", pa.int64())]))


def tool_prepass(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``messages`` with trimmed contents, (conv_id, verbose_trimmed, echo_trimmed, expired_stubbed, chars_removed)).

    ``chars_removed`` is the difference of the lengths, in all three kinds.
    """
    ship(messages.sparkSession)
    columns = messages.columns
    stale = expired_reads(messages).withColumn("_stale", F.lit(True))
    df = messages.join(stale, ["conv_id", "pos"], "left").join(_context(messages), ["conv_id", "pos"], "left")
    live = F.col("role").isin(*ROLES) & F.col("_stale").isNull()
    df = df.withColumn("_cut", F.arrow_udf(_trimmed, "text string, verbose boolean, echo boolean, removed long")(F.when(live, F.col("content")), F.col("context")))
    length = utf16_length(F.col("content"))
    stub = F.concat(F.lit(f"[file content omitted {chr(0x2014)} superseded by a later write ("), length.cast("string"), F.lit(" chars original)]"))
    df = df.withColumn("_out", F.when(F.col("_stale").isNotNull(), stub).otherwise(F.coalesce("_cut.text", "content")))
    flag = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)).alias
    stats = df.groupBy("conv_id").agg(
        flag(F.col("_cut.verbose"))("verbose_trimmed"),
        flag(F.col("_cut.echo"))("echo_trimmed"),
        flag(F.col("_stale"))("expired_stubbed"),
        F.sum(F.when(F.col("_stale").isNotNull(), length - utf16_length(F.col("_out"))).otherwise(F.coalesce("_cut.removed", F.lit(0)))).cast("long").alias("chars_removed"),
    )
    return df.select(*[F.col("_out").alias(c) if c == "content" else c for c in columns]), stats
