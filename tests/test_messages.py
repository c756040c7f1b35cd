"""Message operators against small fixtures."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import content as C
from weftline.functions.entities import entities
from weftline.functions.kernels import entities as python_entities
from weftline.functions.units import js_trim, utf16_length
from weftline.operators import references as R
from weftline.operators.dedup import exact_duplicates, fuzzy_duplicates, near_pairs
from weftline.sources.messages import from_conversations, from_documents, validate

MESSAGE = "conv_id long, pos int, id string, role string, content string, tool_calls array<string>"
PROSE = "The retry worker waits before it sends another request to the queue service. It then reports what it found to the log. "


def conversation(spark, contents, role="user", conv=1):
    return spark.createDataFrame([(conv, i, f"m{i}", role if isinstance(role, str) else role[i], c, None) for i, c in enumerate(contents)], MESSAGE)


@pytest.mark.parametrize(
    "text, reason",
    [
        ("```py\nx = 1\n```", "code_fence"),
        ("    a = 1\n    b = 2", "indented_code"),
        ("so $x+y$ holds", "latex_math"),
        ("for all x ∈ S", "unicode_math"),
        ('{"a": 1}', "json_structure"),
        ("name: a\nkind: b", "yaml_structure"),
        ("x\nRoses are red\nViolets are blue\nSugar is sweet\n", "verse_pattern"),
        ("a\nb\nc\n" + "d" * 200, "high_line_length_variance"),
        ("{}[]()<>", "high_special_char_ratio"),
        ("SELECT a FROM t GROUP  BY a", "sql_content"),
        ("union where select", "sql_content"),
        ("key AKIA" + "A1" * 8, "api_key"),
        ("use tok-" + "a1b2c3d4e5" * 2 + " here", "api_key"),
        ("Therefore it holds. Hence it ends. Thus we stop.", "reasoning_chain"),
        ("Proof: easy", "reasoning_chain"),
        ("1. a\n2. b\n3. c\nthus d", "reasoning_chain"),
        ("see https://example.com/x", "url"),
        ("a@b.org", "email"),
        ("call 555-123-4567 now", "phone"),
        ("since version 3", "version_number"),
        ("at 10.0.0.1 there", "ip_or_semver"),
        ('"name" : x', "quoted_key"),
        ("we shall see", "legal_term"),
        ("he said “this is a long quote”", "direct_quote"),
        ("it weighs 5 kg", "numeric_with_units"),
        ("Traceback (most recent call last)", "error_traceback"),
        ("got status code: 404 here", "http_error"),
        ("Permission denied", "failure_signature"),
    ],
)
def test_detectors(spark, text, reason):
    df = spark.createDataFrame([(text,), ("a quiet walk along the river",)], "t string").select(C.reasons(F.col("t")).alias("r"), C.hard_reasons(F.col("t")).alias("h"))
    got = df.collect()
    assert reason in got[0]["r"] and got[1]["r"] == []
    assert got[0]["h"] == [r for r in got[0]["r"] if r in C.HARD]


def test_detectors_leave_prose_alone(spark):
    texts = ["add 5 g of salt", "select a view from the set", "my-long-hyphenated-class-name-for-a-button", "therefore we stop", "it is 50% done", ""]
    got = [r["r"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.reasons(F.col("t")).alias("r")).collect()]
    assert got == [[]] * len(texts)


def test_entities_in_both_engines(spark):
    texts = ["The PaymentService calls fetchData and user_id on npm in Berlin, 30 seconds, src/a.ts v1.2.3", "Étude in Lyon, 50%x ./b.json https://a.b/c", "", "NEW YORK CITY npm Npm"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(entities(F.col("t"), 500)).collect()]
    assert got == [python_entities(t, 500) for t in texts]


def test_exact_duplicates_keep_the_last_or_the_first_recent(spark):
    long = PROSE * 3
    got = exact_duplicates(conversation(spark, [long, "x", long, "y", "z", "w", "v"]), 4).collect()
    assert [(r["pos"], r["duplicate_of"], r["duplicate_of_id"]) for r in got] == [(0, 2, "m2")]
    got = exact_duplicates(conversation(spark, [long, "x", "y", long, long]), 2).collect()
    assert sorted((r["pos"], r["duplicate_of"]) for r in got) == [(0, 3), (4, 3)]
    assert exact_duplicates(conversation(spark, ["short", "short"])).count() == 0
    # 199 characters are too few, 200 enough.
    assert exact_duplicates(conversation(spark, ["a" * 199] * 2 + ["b" * 200] * 2), 0).select("pos").collect() == [(2,)]


def lined(*lines):
    return "\n".join(f"{x} is a line of some length that says {x} again" for x in lines)


def brute_jaccard(a, b):
    from collections import Counter

    x, y = (Counter(v.strip().lower() for v in t.split("\n") if v.strip()) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def test_near_copies_and_their_groups(spark):
    base = [f"l{i}" for i in range(20)]
    texts = [lined(*base), lined(*base[:19], "x"), lined(*base[:18], "x", "y"), lined(*base[:12], *[f"z{i}" for i in range(8)]), "other\n" + lined("q", "r", "s", "t"), lined(*base), lined(*["same"] * 9, "u"), lined(*["same"] * 9, "v")]
    m = conversation(spark, texts)
    got = {(r["a"], r["b"]): r["similarity"] for r in near_pairs(m, 0.85, 0).collect()}
    fine = [i for i in range(len(texts)) if i != 0]  # 0 is an exact copy of 5
    want = {(i, j): round(brute_jaccard(texts[i], texts[j]), 6) for i in fine for j in fine if i < j and brute_jaccard(texts[i], texts[j]) >= 0.85}
    # 6 and 7 share nine equal lines out of 11: below the limit; with a lower one their repeated first lines count.
    assert got == want and (1, 2) in got and (2, 5) not in got
    assert (6, 7) in {(r["a"], r["b"]) for r in near_pairs(m, 0.8, 0).collect()}
    # 5 is linked to 2 through 1 only; similarity is still that to the one that stays.
    group = {r["pos"]: r for r in fuzzy_duplicates(m, 0.85, 0).collect()}
    assert {p: r["duplicate_of"] for p, r in group.items()} == {1: 5, 2: 5}
    assert group[2]["similarity"] == round(brute_jaccard(texts[2], texts[5]), 6) < 0.85 and group[1]["duplicate_of_id"] == "m5"
    # In a recency window the first recent one stays.
    assert {r["pos"]: r["duplicate_of"] for r in fuzzy_duplicates(m, 0.85, 7).collect()} == {2: 1, 5: 1}
    assert near_pairs(m.limit(0)).count() == 0 and fuzzy_duplicates(m.limit(0)).count() == 0


def test_importance_against_brute_force(spark):
    import random

    rng = random.Random(3)
    names = [f"get{c}xThing" for c in "ABCDEFGHIJ"]
    texts = [" ".join(rng.sample(names, rng.randint(0, 2))) + " said" for _ in range(150)]
    got = {r["pos"]: r for r in R.importance(conversation(spark, texts)).collect()}
    sets = [{w.lower() for w in t.split() if w != "said"} for t in texts]
    refs = [sum(1 for t in sets[i + 1 :] if t & s) for i, s in enumerate(sets)]
    assert [got[i]["refs"] for i in range(150)] == refs
    assert [got[i]["importance"] for i in range(150)] == pytest.approx([min(1, r / max(refs) * 0.5 + i / 149 * 0.1) for i, r in enumerate(refs)], abs=1e-6)


def test_importance_signals(spark):
    texts = ["use Postgres rather than that", "Wait, scratch that", "a breaking change", "always, actually, a deadline", "plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.signals(F.col("t"))).collect()]
    assert got == [15, 25, 10, 40, 0]


def test_coreference(spark):
    m = conversation(spark, ["fetchData reads user_id", "nothing", "fetchData again", "user_id and fetchData"])
    got = {r["entity"]: (r["defined_at"], r["referenced_at"]) for r in R.coreference(m).collect()}
    assert got == {"fetchData": (0, [2, 3]), "user_id": (0, [3])}
    lost = R.orphaned(R.coreference(m), m.where("pos = 0"), m.where("pos = 2"))
    assert [r["entity"] for r in lost.collect()] == ["fetchData"]


def test_units_ids_and_validation(spark):
    got = spark.createDataFrame([("a😀",), (None,), ("é",)], "t string").select(utf16_length(F.col("t")), js_trim(F.lit(" \tx \n"))).collect()
    assert [tuple(r) for r in got] == [(3, "x"), (0, "x"), (1, "x")]
    turns = spark.createDataFrame([(1, 5, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [r["id"] for r in from_conversations(turns).orderBy("pos").collect()] == ["1-2", "1-2-2", "1-5"]
    docs = spark.createDataFrame([(5, "x", "s"), (1005, "y", "s"), (None, None, None)], "doc_id long, text string, source string")
    assert sorted(r["conv_id"] for r in from_documents(docs).collect()) == ["/0", "s/0", "s/1"]
    with pytest.raises(Exception, match="needs an id"):
        validate(spark.createDataFrame([(None,)], "id string")).collect()
