"""Streams of messages against the same rows as a table."""

import datetime as dt

from tests.test_messages import PROSE
from weftline.operators.options import CompressOptions
from weftline.sources.store import load
from weftline.streaming.arrivals import compress_batches, sifted, token_windows

SHAPE = "conv_id long, pos int, id string, role string, content string, tool_calls array<string>, ts timestamp"


def streamed(spark, tmp_path, df, schema):
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_sifting_and_windows(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, 0, "a", "system", PROSE * 3, None, at(1)), (1, 1, "b", "user", PROSE * 3, None, at(2)), (1, 2, "c", "user", '{"a": 1}' + " " * 200, None, at(12)), (2, 0, "d", "user", "short", None, at(3)), (2, 1, "e", "user", None, None, None)]
    table = spark.createDataFrame(rows, SHAPE)
    stream = streamed(spark, tmp_path, table, SHAPE)
    query = sifted(stream).writeStream.format("memory").queryName("sifted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination()
    got = {r["id"]: r["verdict"] for r in spark.table("sifted").collect()}
    assert got == {r["id"]: r["verdict"] for r in sifted(table).collect()} == {"a": "preserved_role", "b": None, "c": "hard_t0:json_structure", "d": "short_content", "e": "short_content"}
    query = token_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination()
    got = sorted((r["conv_id"], r["start"].minute, r["messages"]) for r in spark.table("windows").collect())
    assert got == [(1, 0, 2), (1, 10, 1), (2, 0, 1)]


def test_batches_are_published(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", PROSE * 5), (1, 1, "assistant", PROSE * 6)], "conv_id long, turn long, role string, text string")
    stream = streamed(spark, tmp_path, turns, turns.schema)
    query = compress_batches(stream, str(tmp_path / "out"), CompressOptions(recency_window=0)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    query.awaitTermination()
    messages, kept = load(spark, str(tmp_path / "out" / "batch-0"))
    assert messages.where("action = 'compressed'").count() == 2 and kept.count() == 2
