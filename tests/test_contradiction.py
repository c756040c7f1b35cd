"""Contradictions against a message-by-message pass."""

import math
import random
import re

from weftline.operators import contradiction
from weftline.operators.contradiction import SIGNALS, contradictions

MESSAGE = "conv_id long, pos int, id string, role string, content string, tool_calls array<string>"


def slow(rows):
    fine = [(p, r, t, set(re.findall(r"\b[a-z]{3,}\b", t.lower()))) for p, r, t in rows if len(t) >= 50]
    df = {}
    for *_, w in fine:
        for x in w:
            df[x] = df.get(x, 0) + 1
    weight = lambda x: math.log(1 + len(fine) / df[x]) if len(fine) >= 3 else 1.0
    out = {}
    for i, (p, r, t, w) in enumerate(fine):
        found = next((k for k, x in SIGNALS.items() if re.search(x.replace(r"\<", r"\b").replace(r"\>", r"\b"), t)), None)
        if not found:
            continue
        best, at = 0.0, None
        for q, s, _, v in reversed(fine[:i]):
            overlap = 2 * sum(map(weight, sorted(v & w))) / (sum(map(weight, sorted(v))) + sum(map(weight, sorted(w))))
            if overlap >= (0.15 if r == s else 0.225) and overlap > best + 1e-12:
                best, at = overlap, q
        if at is not None and at not in out:
            out[at] = (p, round(best, 6), found)
    return out


def test_contradictions(spark):
    rng = random.Random(8)
    topics = ["deploy the queue worker with redis storage", "store the session tokens in the local database", "render the report pages with the template engine"]
    openings = ["we should ", "Actually, ", "I think we can ", "Scratch that and ", "wait, now ", "please "]
    table, want = [], {}
    for conv in range(12):
        rows = []
        for pos in range(rng.randint(2, 14)):
            text = rng.choice(openings) + rng.choice(topics) + " " + " ".join(rng.choice(topics).split()[:3]) + rng.choice([" today", " by tomorrow morning", ""])
            rows.append((pos, rng.choice(["user", "assistant"]), text))
        table += [(conv, p, f"{conv}-{p}", r, t, None) for p, r, t in rows]
        want |= {(conv, p): v for p, v in slow(rows).items()}
    got = {(r["conv_id"], r["pos"]): (r["superseded_by"], r["overlap"], r["signal"]) for r in contradictions(spark.createDataFrame(table, MESSAGE)).collect()}
    assert got == want and len(want) > 10
    assert contradictions(spark.createDataFrame([], MESSAGE)).count() == 0


def test_a_long_conversation_moves_its_words_once(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    texts = [rng.choice(["", "Actually, ", "wait, "]) + " ".join(rng.choice(words) for _ in range(rng.randint(9, 20))) for _ in range(150)]
    rows = [(p, rng.choice(["user", "assistant"]), t) for p, t in enumerate(texts)]
    messages = spark.createDataFrame([(1, p, f"1-{p}", r, t, None) for p, r, t in rows], MESSAGE)
    want = slow(rows)
    read = lambda df: {r["pos"]: (r["superseded_by"], r["overlap"], r["signal"]) for r in df.collect()}
    whole = contradictions(messages)
    assert read(whole) == want and len(want) > 30
    # No join of pairs with both messages' words.
    assert "array_intersect" not in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(contradiction, "LONG", 10)
    assert read(contradictions(messages)) == want
    monkeypatch.setattr(contradiction, "LONG", 4096)
    many = [messages.selectExpr(f"conv_id + {k} as conv_id", "pos", "id", "role", "content", "tool_calls") for k in range(3)]
    got = contradictions(many[0].union(many[1]).union(many[2])).collect()
    assert len(got) == 3 * len(want)


def test_corrections_in_small_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    convs = [[sorted(rng.sample(range(30), rng.randint(0, 8))) for _ in range(n)] for n in (0, 1, 2, 9, 14)]
    args = [pa.array([[rng.choice(["a", "b", "", None]) for _ in c] for c in convs], pa.list_(pa.string())), pa.array([[rng.random() < 0.5 for _ in c] for c in convs], pa.list_(pa.bool_())), pa.array(convs, pa.list_(pa.list_(pa.int64())))]
    at_once = contradiction.first_corrections(*args, 0.15).to_pylist()
    monkeypatch.setattr(contradiction, "HELD", 1)
    assert contradiction.first_corrections(*args, 0.15).to_pylist() == at_once and any(at_once)
