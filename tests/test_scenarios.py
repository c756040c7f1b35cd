"""Eight kinds of conversation in our own words: savings, quality and restoring, as a regression gate."""

import pytest

from tests.test_compress import same_after_restore
from tests.test_messages import conversation
from weftline.operators.compress import compress
from weftline.operators.options import CompressOptions

TALK = "The worker takes a job from the queue, runs it and writes what it found to the log. When it fails, the job goes back and waits for a while. "
MORE = "Nobody noticed that the report came late, since the page shows the last good one. We looked at the numbers and they were in the usual range. "
CODE = "```python\ndef load(path):\n    with open(path) as f:\n        return f.read()\n```"
JSON = '{"rows": [' + ", ".join(f'{{"id": {i}, "name": "n{i}"}}' for i in range(12)) + "]}"


def turns(*contents):
    return [c for c in contents], ["user" if i % 2 == 0 else "assistant" for i in range(len(contents))]


SCENARIOS = {
    # name: (contents and roles, least ratio, most ratio)
    "coding": (turns("Please write loadFile for the importer. " + TALK, TALK * 3 + "\n" + CODE + "\n" + MORE * 4, MORE * 2, TALK * 4 + "\n" + CODE, "thanks"), 1.3, 4),
    "long answers": (turns(*[x for i in range(5) for x in (f"Why does step {i} of syncTable take long?", (TALK + MORE) * 6 + f"Step {i} must hold the lock of syncTable.")]), 2.5, 20),
    "tools": (turns(*[x for i in range(6) for x in (JSON.replace("n1", f"n{i}"), "Traceback (most recent call last)\n" + "x" * 150)], TALK * 4), 1.0, 2),
    "short": (turns("hi", "hello there", "how are you", "fine, thanks", "good"), 1.0, 1.0),
    "deep": (turns(*[f"Point {i}: {TALK}{MORE}The value of maxDepth{'abcdefghij'[i % 10]} stays." for i in range(40)]), 1.3, 6),
    "technical": (turns("Proof: it follows that x is even. " + TALK, "Therefore it holds. Hence we stop. Thus it ends. " + MORE), 1.0, 1.0),
    "structured": (turns(JSON, "name: a\nkind: b\nsize: c\n" * 8, TALK * 9 + "The parserTable is kept.", "SELECT a FROM t GROUP BY a ORDER BY a" + " " * 100), 1.2, 4),
    "agent": (turns(*[(TALK * 3 + "readFile src/main.py was asked.") if i % 3 else CODE + "\n" + "short note" for i in range(14)]), 1.5, 8),
}


@pytest.fixture(scope="module")
def table(spark):
    out = None
    for i, (name, ((contents, roles), _, _)) in enumerate(SCENARIOS.items()):
        one = conversation(spark, contents, roles, conv=i)
        out = one if out is None else out.unionByName(one)
    return out


def test_scenarios(spark, table):
    done = compress(table, CompressOptions(recency_window=0))
    stats = {r["conv_id"]: r for r in done.stats.collect()}
    for i, (name, (_, least, most)) in enumerate(SCENARIOS.items()):
        s = stats[i]
        assert least <= s["ratio"] <= most, (name, s["ratio"])
        assert s["quality_score"] is None or s["quality_score"] >= 0.8, (name, s["quality_score"])
    assert same_after_restore(spark, table, done)


def test_nothing_grows_and_a_second_run_changes_nothing(spark, table):
    done = compress(table, CompressOptions(recency_window=0))
    first = done.messages
    assert first.where("action <> 'preserved' and output_chars >= input_chars").count() == 0
    once = sorted((r["conv_id"], r["pos"], r["content"]) for r in first.collect())
    assert once == sorted((r["conv_id"], r["pos"], r["content"]) for r in compress(table.repartition(5), CompressOptions(recency_window=0)).messages.collect())
