"""Session logs: one JSON object a line, as chat tools write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "struct<type:string,text:string,name:string,id:string,input:string,content:string>"
LINE = "struct<type:string,uuid:string,message:struct<content:string>>"


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, pos, id, role, content, tool_calls) of every ``*.jsonl`` file under ``path``; conv_id is the file.

    Lines of users and assistants that hold text are kept, in file order. Content is a string or a list of blocks: texts and results are
    joined by line ends, tool calls shown with at most 200 characters of input, thoughts left out. A user line made of
    tool results only has role ``tool``.
    """
    # Whole files, so that lines keep their order; a session is one file.
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.jsonl").select(F.input_file_name().alias("conv_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    line = raw.where(F.trim("line") != "").select("conv_id", "line_no", F.from_json("line", LINE).alias("l"), "line")
    said = line.where(F.col("l.type").isin("user", "assistant")).select("conv_id", "line_no", F.col("l.type").alias("type"), F.col("l.uuid").alias("uuid"), F.col("l.message.content").alias("raw"))
    blocks = F.from_json("raw", f"array<{BLOCK}>")
    listed = F.col("raw").startswith("[") & blocks.isNotNull()
    inner = lambda b: F.when(b["content"].startswith("["), F.array_join(F.transform(F.from_json(b["content"], "array<struct<text:string>>"), lambda x: x["text"]), "\n")).otherwise(b["content"])

    def shown(b):
        call = F.concat(F.lit("[tool_call: "), b["name"], F.lit("("), F.substring(F.coalesce(b["input"], F.lit("{}")), 1, 200), F.lit(")]"))
        return F.when(b["type"] == "thinking", None).when(b["type"] == "tool_use", call).when(b["type"] == "tool_result", inner(b)).otherwise(F.when(b["text"] != "", b["text"]))

    flat = said.select(
        "*",
        F.when(listed, F.array_join(F.transform(blocks, shown), "\n")).otherwise(F.col("raw")).alias("content"),
        F.when(listed, F.forall(blocks, lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False)))).otherwise(False).alias("results"),
        F.when(listed & (F.col("type") == "assistant"), F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.to_json(F.struct(b["id"].alias("id"), b["name"].alias("name"), F.coalesce(b["input"], F.lit("{}")).alias("arguments"))))).alias("calls"),
    ).where(F.trim("content") != "")
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("line_no")) - 1
    role = F.when(F.col("type") == "assistant", "assistant").when(F.col("results"), "tool").otherwise("user")
    return flat.select("conv_id", pos.alias("pos"), F.coalesce("uuid", F.concat(F.lit("msg-"), (pos + 1).cast("string"))).alias("id"), role.alias("role"), "content", F.when(F.size("calls") > 0, F.col("calls")).alias("tool_calls"))
