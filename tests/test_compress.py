"""The compression pipeline: every branch, restoring, budgets, measures."""

import math

import pytest
from pyspark.sql import functions as F

from tests.test_messages import MESSAGE, PROSE, conversation, lined
from weftline.functions import adapters as A
from weftline.functions import kernels as K
from weftline.operators import compress as X
from weftline.operators import quality_metrics as Q
from weftline.operators.feedback import distillation_pairs
from weftline.operators.flow import REACH, chains_in
from weftline.operators.options import CompressOptions
from weftline.operators.prepass import tool_prepass
from weftline.operators.restore import restore, restored
from weftline.sources import store

OPEN = dict(recency_window=0, dedup=False)


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r["conv_id"], r.get("pos", r.get("message_index", 0))))


def same_after_restore(spark, messages, done):
    back = rows(restored(done.messages, done.verbatim))
    want = rows(messages)
    return [(r["conv_id"], r["pos"], r["id"], r["role"], r["content"]) for r in back] == [(r["conv_id"], r["pos"], r["id"], r["role"], r["content"]) for r in want]


def test_default_rules_and_restoring(spark):
    texts = [PROSE * 6, PROSE * 5 + "End.", "short", '{"a": [1, 2, 3]}' + " " * 120, PROSE * 6, "x", None, "y", "z"]
    m = conversation(spark, texts)
    done = X.compress(m)
    out = rows(done.messages)
    assert [r["action"] for r in out[:2]] == ["deduped", "compressed"] and out[0]["content"] == f"[dup of m4 — {len(PROSE) * 6} chars]"
    assert all(r["output_chars"] < r["input_chars"] for r in out if r["action"] != "preserved")
    assert same_after_restore(spark, m, done)
    stats = done.stats.first()
    assert stats["messages_in"] == len(texts) and stats["messages_deduped"] == 1 and stats["messages_compressed"] == 2 and stats["ratio"] > 1 and stats["quality_score"] <= 1
    reasons = {r["message_index"]: r["reason"] for r in done.trace.collect()}
    assert reasons == {0: "exact_duplicate", 1: "compressible_prose", 2: "short_content", 3: "hard_t0:json_structure", 4: "compressible_prose", **{i: "recency_window" for i in (5, 6, 7, 8)}}
    assert X.compress(m.limit(0)).messages.count() == 0 and X.compress(m.limit(0)).stats.count() == 0


def test_repeated_rows_come_back_once_each(spark):
    from weftline.sources.messages import from_conversations

    turns = spark.createDataFrame([(1, 1, "user", PROSE * 4), (1, 1, "user", PROSE * 4), (1, 2, "assistant", PROSE * 5)], "conv_id long, turn long, role string, text string")
    m = from_conversations(turns)
    done = X.compress(m, CompressOptions(recency_window=0))
    assert same_after_restore(spark, m, done) and m.count() == 3


def test_groups_merge_by_role_and_carry_provenance(spark):
    m = conversation(spark, [PROSE * 3, PROSE * 3 + "Also.", PROSE * 4, "short"], ["user", "user", "assistant", "user"])
    out = rows(X.compress(m, CompressOptions(recency_window=0, embed_summary_id=True, source_version=7, namespace="x:")).messages)
    assert [r["ids"] for r in out] == [["m0", "m1"], ["m2"], ["m3"]] and "(2 messages merged)" in out[0]["content"]
    assert out[0]["content"].startswith(f"[summary#{out[0]['original']['summary_id']}: ") and out[0]["original"]["version"] == 7 and out[0]["original"]["parent_ids"] is None
    assert out[2]["original"] is None and out[2]["action"] == "preserved"


def test_preserved_by_role_calls_patterns_and_classifier(spark):
    long = PROSE * 4
    rows_ = [(1, 0, "a", "system", long, None), (1, 1, "b", "user", long, ["call"]), (1, 2, "c", "user", long + " TICKET-9", None), (1, 3, "d", "user", long + " keepme", None), (1, 4, "e", "user", "[summary: x]" + long, None), (1, 5, "f", "user", long, None)]
    m = spark.createDataFrame(rows_, MESSAGE)
    verdict = lambda t: {"decision": "preserve" if "keepme" in t else "compress", "confidence": 0.9, "reason": "asked"}
    done = X.compress(m, CompressOptions(**OPEN, preserve_patterns=((r"TICKET-\d+", "ticket"),), classifier=verdict))
    assert {r["message_index"]: r["reason"] for r in done.trace.collect()} == {0: "preserved_role", 1: "tool_calls", 2: "pattern:ticket", 3: "llm_preserved:asked", 4: "already_compressed", 5: "compressible_prose"}
    stats = done.stats.first()
    assert (stats["messages_pattern_preserved"], stats["messages_llm_preserved"], stats["messages_llm_classified"]) == (1, 1, 2)


def test_code_is_kept_and_prose_around_it_summarised(spark):
    code = "```py\nx = fetchData()\n```"
    m = conversation(spark, [PROSE * 5 + "\n" + code + "\n" + PROSE * 3, "Look:\n" + code.replace("x = fetchData()\n", "x = fetchData()\n" * 6) + "\n" + "x" * 60, "```\n" + "y\n" * 90 + "```"])
    out = rows(X.compress(m, CompressOptions(**OPEN)).messages)
    assert out[0]["action"] == "code_split" and out[0]["content"].endswith("]\n\n" + code) and out[0]["content"].startswith("[summary: ")
    assert [r["reason"] for r in out[1:]] == ["code_fence_no_prose"] * 2


def test_superseded_near_copies_and_importance(spark):
    first = "We should store the session records in the postgres database for the billing service of the shop. " * 3
    fix = "Actually, we should store the session records in the redis database for the billing service of the shop. " * 3
    base = [f"l{i}" for i in range(20)]
    m = conversation(spark, [first, "unrelated chatter about lunch and weather " * 5, fix, lined(*base), lined(*base[:19], "new")])
    done = X.compress(m, CompressOptions(recency_window=0, fuzzy_dedup=True, contradiction_detection=True))
    out = {r["pos"]: r for r in rows(done.messages)}
    assert out[0]["action"] == "contradicted" and out[0]["content"].startswith("[superseded by m2 (explicit_correction) — ")
    assert out[3]["action"] == "fuzzy_deduped" and out[3]["content"] == f"[near-dup of m4 — {len(lined(*base))} chars, ~90% match]"
    assert same_after_restore(spark, m, done)
    m = conversation(spark, ["getAlphaThing must always work, actually. " * 4] + ["getAlphaThing here. " * 8] * 4)
    got = {r["message_index"]: r["reason"] for r in X.compress(m, CompressOptions(**OPEN, importance_scoring=True)).trace.collect()}
    assert got[0] == "importance:0.90" and not got[4].startswith("importance")


def test_adapters_depths_relevance_and_large_observations(spark):
    line = "The retry worker waits before it sends another request to the queue.\n"
    doc = "# One\n" + line * 6 + "## Two\n" + line * 6
    m = conversation(spark, [doc, "lunch was nice and warm today " * 10, PROSE * 8])
    out = rows(X.compress(m, CompressOptions(**OPEN, adapters=(A.MarkdownAdapter(),), relevance_threshold=3)).messages)
    assert out[0]["reason"] == "adapter:markdown" and out[0]["content"].startswith("# One\n\n## Two\n\n")
    assert out[1]["ids"] == ["m1", "m2"]
    lone = conversation(spark, ["lunch was nice and warm today " * 10])
    assert rows(X.compress(lone, CompressOptions(**OPEN, relevance_threshold=3)).messages)[0]["content"] == "[1 message of general discussion omitted]"
    sizes = [rows(X.compress(conversation(spark, [PROSE * 9]), CompressOptions(**OPEN, compression_depth=d)).messages)[0]["output_chars"] for d in ("gentle", "moderate", "aggressive")]
    assert sizes[0] >= sizes[1] >= sizes[2]
    assert rows(X.compress(m, CompressOptions(recency_window=3, observation_threshold=50)).messages)[0]["action"] == "compressed"
    assert {r["action"] for r in rows(X.compress(m, CompressOptions(recency_window=0, compression_threshold=10_000)).messages)} == {"preserved"}


def broken(text):
    raise RuntimeError("down")


def test_summarisers(spark):
    m = conversation(spark, [PROSE * 5])
    get = lambda **o: rows(X.compress(m, CompressOptions(**OPEN, **o)).messages)[0]["content"]
    plain = get()
    assert "own words" in get(summarizer=lambda t: "own words") and get(summarizer=broken) == plain and get(summarizer=lambda t: t * 2) == plain
    assert get(token_classifier=K.pattern_classifier(["queue|log"])).startswith("[summary: queue log.")
    assert get(discourse_aware=True).startswith("[summary: ") and get(entropy_scorer=lambda s: [float(i) for i in range(len(s))]).startswith("[summary: ")


def test_definitions_are_put_before_summaries(spark):
    m = conversation(spark, ["The fetchData helper reads every row from the queue. " + PROSE * 4, "x" * 10, "now fetchData fails"], ["user", "assistant", "user"])
    done = X.compress(m, CompressOptions(recency_window=2, dedup=False, coreference=True))
    assert rows(done.messages)[0]["content"].startswith("[context: The fetchData helper reads every row from the queue.] [summary: ")
    assert same_after_restore(spark, m, done)


def test_flow_chains(spark):
    contents = ["How does the cache of the service work in detail?", "It keeps the hot keys in memory. " * 6, "Thanks, that helps.", "Please add a retry to the worker loop.", "I've added the retry with a backoff. " * 5, "x" * 230, "ok thanks, good"]
    roles = ["user", "assistant", "user", "user", "assistant", "user", "assistant"]
    m = conversation(spark, contents, roles)
    done = X.compress(m, CompressOptions(recency_window=0, conversation_flow=True))
    out = rows(done.messages)
    # The last one confirms the request, over a message that isn't part of the chain; order comes back all the same.
    assert [r["reason"] for r in out] == ["flow:qa", "flow:request_action", "hard_t0:base64_content"] and [r["ids"] for r in out] == [["m0", "m1", "m2"], ["m3", "m4", "m6"], ["m5"]]
    m2 = conversation(spark, ["y" * 230, "ok thanks, good", "z"], ["user", "assistant", "user"])
    assert rows(X.compress(m2, CompressOptions(recency_window=1, conversation_flow=True)).messages)[0]["reason"] == "flow:acknowledgment"
    assert out[0]["content"].startswith("[summary: Q: How does the cache") and out[0]["content"].endswith("(confirmed) (3 messages, qa)]")
    assert same_after_restore(spark, m, done)


def test_flow_of_a_long_conversation_equals_one_pass(spark, monkeypatch):
    import random
    from collections import namedtuple

    from weftline.operators import flow
    from weftline.operators.decisions import annotated, features, ruled

    rng = random.Random(1)
    texts = [rng.choice(["What is it now, really?", "Please fix the loop.", "I've fixed the loop.", "thanks a lot!", "Actually no, that is wrong.", "plain talk " * 20]) for _ in range(60)]
    roles = [rng.choice(["user", "assistant"]) for _ in texts]
    m = conversation(spark, texts, roles)
    o = CompressOptions(recency_window=0)
    df = ruled(annotated(features(m, o), o), o)
    whole = rows(flow.flow_chains(df).withColumnRenamed("first", "pos"))
    monkeypatch.setattr(flow, "STRETCH", 7)
    parts = rows(flow.flow_chains(df).withColumnRenamed("first", "pos"))
    assert parts == whole and len(whole) > 10
    Row = namedtuple("Row", "pos able asks requests confirms corrects acts role size")
    assert chains_in([Row(0, True, False, False, False, False, False, "user", 20)], 0, 5, 1)[0] == [] and REACH == 5


def test_clusters(spark):
    a = "The billing service uses invoiceTable and paymentQueue for every order of the shop. " * 2
    b = "Every order of the shop goes through paymentQueue and invoiceTable of the billing service. " * 2
    c = "Clouds drift slowly above quiet mountains while rivers wander towards distant oceans, endlessly. " * 2
    m = conversation(spark, [a, b, c, "x"], ["user", "assistant", "user", "user"])
    done = X.compress(m, CompressOptions(recency_window=1, dedup=False, semantic_clustering=True))
    out = rows(done.messages)
    assert out[0]["ids"] == ["m0", "m1"] and out[0]["reason"].startswith("cluster:") and "invoiceTable" in out[0]["content"]
    assert same_after_restore(spark, m, done)


def test_store_publishes_whole_and_restores_all_the_way(spark, tmp_path):
    at = str(tmp_path / "store")
    m = conversation(spark, [PROSE * 5, PROSE * 6 + "More.", "tail"])
    with pytest.raises(FileNotFoundError):
        store.load(spark, at)
    store.publish(X.compress(m, CompressOptions(recency_window=1)), at)
    messages, kept = store.load(spark, at)
    again = messages.withColumn("content", F.concat(F.lit("again: "), F.col("content"))).withColumn("pos", F.when(F.col("pos") == 2, 1).otherwise(F.col("pos")))
    second = X.compress(again, CompressOptions(recency_window=0, short_chars=1, dedup=False))
    store.publish(second, at)
    messages, kept = store.load(spark, at)
    first = next(r for r in rows(messages) if r["original"])
    assert first["original"]["parent_ids"] and restore(messages, kept).expanded == 1
    done = restore(messages, kept, recursive=True)
    assert [r["content"] for r in rows(done.messages)][:2] == [PROSE * 5, PROSE * 6 + "More."] and done.missing.count() == 0 and done.expanded == 2
    assert store.prune(spark, at) == 1 and store.load(spark, at)[0].count() == messages.count()


def test_missing_and_circular_ids(spark):
    shape = "conv_id long, pos int, id string, role string, content string, tool_calls array<string>, original struct<ids:array<string>,summary_id:string,parent_ids:array<string>,version:bigint>"
    loop = {"ids": ["a"], "summary_id": "s", "parent_ids": None, "version": 0}
    messages = spark.createDataFrame([(1, 0, "a", "user", "A", None, loop), (1, 1, "b", "user", "B", None, dict(loop, ids=["x", "c"])), (1, 2, "d", "user", "D", None, dict(loop, ids=["gone"]))], shape)
    kept = spark.createDataFrame([(1, 0, "a", "user", "A", None, loop), (1, 1, "c", "user", "C", None, None)], shape)
    once = restore(messages, kept)
    assert [r["id"] for r in rows(once.messages)] == ["a", "c", "d"] and (once.expanded, once.passed) == (2, 1) and sorted(r["id"] for r in once.missing.collect()) == ["gone", "x"]
    deep = restore(messages, kept, recursive=True)
    assert [r["id"] for r in rows(deep.messages)] == ["a", "c", "d"] and deep.messages.where("id = 'a'").count() == 1


def test_prepass(spark):
    path = "/srv/app/src/main.py"
    block = "an echoed block of text that is long enough " * 6
    tests = "\n".join(f"  ✓ works well {i}" for i in range(12))
    contents = [f"cat {path}", "z" * 2500, "I wrote " + path, block, f"x\n\n{block}", tests, block]
    roles = ["assistant", "tool", "assistant", "assistant", "tool", "function", "user"]
    out, stats = tool_prepass(conversation(spark, contents, roles))
    got = [r["content"] for r in rows(out)]
    assert got[1] == "[file content omitted — superseded by a later write (2500 chars original)]" and got[4] == f"x\n\n[content from preceding turn omitted ({len(block.strip())} chars)]"
    assert got[5] == "[... 12 passing test lines omitted ...]" and got[6] == block and got[0] == contents[0]
    s = stats.first()
    assert (s["verbose_trimmed"], s["echo_trimmed"], s["expired_stubbed"]) == (1, 1, 1) and s["chars_removed"] == sum(len(a) - len(b) for a, b in zip(contents, got))
    done = X.compress(conversation(spark, contents, roles), CompressOptions(tool_prepass=True))
    assert done.stats.first()["messages_tool_prepass_trimmed"] == 3


def brute_window(spark, m, n, limit, low=0):
    lo, hi = low, n - 1
    fits = lambda w: X.counted(X.compress(m, CompressOptions(recency_window=w)).units, CompressOptions()).first()["output_tokens"] <= limit
    while lo < hi:
        mid = math.ceil((lo + hi) / 2)
        lo, hi = (mid, hi) if fits(mid) else (lo, mid - 1)
    return lo


def test_budgets(spark):
    texts = [PROSE * (3 + i % 4) + f"Note {i} says getThing{'abcdefgh'[i]} must go." for i in range(8)]
    m = conversation(spark, texts, ["user", "assistant"] * 4)
    small = conversation(spark, ["tiny", "talk"], conv=2)
    total = sum(math.ceil(len(t) / 3.5) for t in texts)
    limit = int(total * 0.7)
    done = X.compress(m.unionByName(small), CompressOptions(token_budget=limit))
    fit = {r["conv_id"]: r for r in done.fit.collect()}
    assert fit[1]["recency_window"] == brute_window(spark, m, 8, limit) and fit[1]["fits"] and fit[1]["token_count"] <= limit
    assert fit[2].asDict() == {"conv_id": 2, "fits": True, "token_count": 4, "recency_window": 2}
    assert same_after_restore(spark, m.unionByName(small), done)
    # Too small a budget: the least window, and then cutting.
    tight = X.compress(m, CompressOptions(token_budget=200))
    assert not tight.fit.first()["fits"] and tight.fit.first()["recency_window"] == 0


def test_force_converge_and_tiers(spark):
    hard = "{" + '"k": "' + "v" * 900 + '"}'
    m = conversation(spark, [hard, hard.replace("v", "w"), PROSE * 3, "end"])
    done = X.compress(m, CompressOptions(recency_window=1, token_budget=380, force_converge=True, min_recency_window=0))
    out = rows(done.messages)
    assert out[0]["content"].startswith(f"[truncated — {len(hard)} chars: " + hard[:20]) and out[0]["reason"] == "force_converge" and same_after_restore(spark, m, done)
    assert done.fit.first()["token_count"] == sum(math.ceil(len(r["content"]) / 3.5) for r in out)
    tier = X.compress(m, CompressOptions(recency_window=1, token_budget=150, budget_strategy="tiered"))
    assert {r["reason"] for r in rows(tier.messages)} & {"tightened", "stubbed"} and same_after_restore(spark, m, tier)
    auto = X.compress(conversation(spark, [PROSE * 20, "end"]), CompressOptions(token_budget=60, compression_depth="auto"))
    assert auto.fit.count() == 1 and auto.messages.count() == 2


def test_measures(spark, tmp_path):
    code = "```py\nx = 1\n```"
    m = conversation(spark, [f"The fetchData call in Berlin. {PROSE * 4}\n{code}\n{PROSE * 2}", PROSE * 6, "tail words"])
    done = X.compress(m, CompressOptions(recency_window=1))
    q = Q.compressed_quality(done.messages, done.verbatim).first()
    assert q["code_block_integrity"] == 1 and q["negative_compressions"] == 0 and 0 <= q["entity_retention"] <= 1 and q["information_density"] > 0
    each = rows(Q.message_quality(done.messages, done.verbatim))
    assert all(r["code_blocks_intact"] and r["local_ratio"] > 1 for r in each) and len(each) == 2
    checked = {r["label"]: r["passed"] for r in Q.probes(done.messages, {"has code": Q.code_contains("x = 1"), "no such": Q.contains("zebra"), "long": Q.at_least(20), "rx": Q.finds(r"\bfetch\w+")}).collect()}
    assert checked["has code"] and not checked["no such"] and checked["long"]
    pairs = distillation_pairs(done.messages, done.verbatim).collect()
    assert len(pairs) == 2 and all(p["input"] != p["output"] for p in pairs)
    text = spark.createDataFrame([("[summary: Ok.]",), ("[summary: It works. It works.]",), ("[summary: big red balloon over there. It runs.]",), ("",)], "t string").select(Q.incoherent(F.col("t"))).collect()
    assert [r[0] for r in text] == [1, 1, 1, 0]
    points = spark.createDataFrame([(1, 0, 3.2, 0.7), (1, 2, 2.1, 0.9), (1, 4, 1.2, 1.0)], "conv_id long, recency_window int, ratio double, quality_score double")
    assert Q.tradeoff_summary(points).first().asDict() == {"conv_id": 1, "quality_at_2x": 0.9, "quality_at_3x": 0.7, "max_ratio_above_80": 2.1}
    run = lambda x, w: (X.compress(x, CompressOptions(recency_window=w)).stats, None)
    swept = rows(Q.sweep(m, [0, 3], run).withColumnRenamed("recency_window", "pos"))
    assert [r["pos"] for r in swept] == [0, 3] and swept[0]["ratio"] > 1 == swept[1]["ratio"]
    shape = "bench string, scenario string, metric string, value double"
    stored = spark.createDataFrame([("q", "a", "ratio", 2.0)], shape)
    Q.save_baseline(stored, str(tmp_path / "base"))
    assert Q.load_baseline(spark, str(tmp_path / "base")).collect() == stored.collect()
    base = spark.createDataFrame([("q", "a", "avg_entity_retention", 0.9), ("q", "a", "ratio", 2.0), ("q", "b", "ratio", 1.0)], shape)
    now = spark.createDataFrame([("q", "a", "avg_entity_retention", 0.86), ("q", "a", "ratio", 2.1), ("q", "c", "ratio", 1.0)], shape)
    assert sorted((r["scenario"], r["metric"], r["status"]) for r in Q.regressions(base, now).collect()) == [("a", "ratio", "changed"), ("b", "ratio", "missing"), ("c", "ratio", "new")]
