"""Session logs and quality measures on small fixtures."""

import json

from weftline.operators.quality_metrics import quality
from weftline.sources.sessions import read_sessions
from weftline.sources.store import discover


def test_sessions(spark, tmp_path):
    lines = [
        {"type": "user", "uuid": "u1", "message": {"content": "hello there"}},
        {"type": "system", "message": {"content": "no"}},
        {"type": "assistant", "uuid": "a1", "message": {"content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "I look."}, {"type": "tool_use", "id": "t1", "name": "read", "input": {"path": "a.ts"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": [{"text": "one"}, {"text": "two"}]}, {"type": "tool_result", "content": "three"}]}},
        {"type": "user", "message": {"content": "  "}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    got = [(r["pos"], r["id"], r["role"], r["content"], bool(r["tool_calls"])) for r in read_sessions(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, "u1", "user", "hello there", False), (1, "a1", "assistant", 'I look.\n[tool_call: read({"path":"a.ts"})]', True), (2, "msg-3", "tool", "one\ntwo\nthree", False)]


def test_session_discovery(spark, tmp_path):
    for name, n in (("a", 10), ("b", 300), ("c", 50)):
        (tmp_path / f"{name}.jsonl").write_text("x" * n)
    (tmp_path / "d.txt").write_text("y" * 999)
    got = [(r["path"].rsplit("/", 1)[-1], r["length"]) for r in discover(spark, str(tmp_path), 2).collect()]
    assert got == [("b.jsonl", 300), ("c.jsonl", 50)]


def test_quality(spark):
    before = spark.createDataFrame([(1, "a", "fetchData calls user_id"), (1, "b", "sendMail\n```\nx\n```"), (2, "c", None)], "conv_id long, id string, content string")
    after = spark.createDataFrame([(1, "a", "fetchData calls user_id")], "conv_id long, id string, content string")
    got = {r["conv_id"]: tuple(r)[1:] for r in quality(before, after).collect()}
    assert got == {1: (0.667, 0.0, 1.0, 0.467), 2: (1.0, 1.0, 1.0, 1.0)}
