"""Operators that look at one row: language, toxicity, quality rules, pages, chats, tokens."""

import random
import tracemalloc

import numpy as np
import pytest
import tiktoken

from weftline.llm import bpe, chat, html_text, langid, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, words string"
EN = "the quick brown fox jumps over the lazy dog and runs to the river with the other foxes "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft zum fluss mit den anderen "


def rows(texts, lang=None):
    return [(i, t, lang or "en", "s", len(t) if t else 0, "k", "w") for i, t in enumerate(texts)]


EDGE = [None, "", " \n\t ", "!!! 123", "x", EN * 3, EN * 3, EN * 2000, "é\U0001f600 中文", "a" * 5000]


@pytest.fixture(scope="module")
def edge(spark):
    data = rows(EDGE) + [(None, EN, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


# -- language


def ppm_cost(trees, context_set, text, k):
    """Code length of a byte string, byte by byte."""
    total = 0
    classes = sorted({b for tree in trees for b in tree.get(b"", {})})
    for i, b in enumerate(text):
        context = text[max(0, i - langid.ORDER) : i]
        while context not in context_set:
            context = context[1:]
        cost = 0.0
        while True:
            followers = trees[k].get(context) or {}
            n, d = sum(followers.values()), len(followers)
            if b in followers:
                cost += np.log2((n + d) / followers[b])
                break
            if context == b"":
                cost += 8 + (np.log2((n + d) / d) if d else 0)
                break
            if followers:
                cost += np.log2((n + d) / d)
            context = context[1:]
        total += np.floor(cost * langid.SCALE + 0.5) if b in classes or True else 0
    return total


def test_language_code_lengths_equal_a_byte_by_byte_pass():
    samples = {"de": [(DE * 4).encode()], "en": [(EN * 4).encode()]}
    params = langid.LangIdParams(max_contexts=10_000, min_count=1)
    model = langid.train(samples, params)
    trees = []
    for lang in ("de", "en"):
        tree = {}
        for order in range(langid.ORDER + 1):
            for t in samples[lang]:
                for i in range(len(t) - order):
                    tree.setdefault(t[i : i + order], {}).setdefault(t[i + order], 0)
                    tree[t[i : i + order]][t[i + order]] += 1
        trees.append(tree)
    known = set(trees[0]) | set(trees[1])
    texts = [EN.encode(), DE.encode(), b"zzz \xff unseen", (EN + DE).encode() * 3]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.code_lengths(model, data, offsets)
    for i, t in enumerate(texts):
        for k in (0, 1):
            assert got[i, k] == ppm_cost(trees, known, t, k)


def test_language_training_needs_little_room_on_the_driver():
    rng = np.random.default_rng(5)
    samples = {lang: [rng.choice(list(b"abcdefghijklmnopqrstuvwxyz "), 150_000).astype(np.uint8).tobytes()] for lang in ("de", "en", "fr")}
    tracemalloc.start()
    try:
        model = langid.train(samples, langid.LangIdParams(max_contexts=2000))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # About 150 000 distinct runs of five bytes a language: as dictionaries they took 200 MB.
    assert peak < model.cost.nbytes + model.step.nbytes + (40 << 20)


def test_language_edges_and_accuracy(spark, edge):
    model = langid.train({"en": [(EN * 20).encode()], "de": [(DE * 20).encode()]})
    got = {r["doc_id"]: r for r in langid.identify(edge, model).collect()}
    assert len(got) == len(EDGE) + 1
    for i in (0, 1, 2, 3):
        assert got[i]["pred_lang"] == "und" and not got[i]["accepted"]
    assert got[5]["pred_lang"] == "en" == got[7]["pred_lang"] and got[5]["accepted"]
    kept = langid.accepted(edge, model)
    assert kept.columns == edge.columns and kept.where("doc_id = 7").first()["text"] == EN * 2000
    assert langid.identify(edge.limit(0), model).count() == 0
    nothing = langid.fit(edge.limit(0))
    assert {r["pred_lang"] for r in langid.identify(edge, nothing).collect()} == {"und"}


# -- toxicity


def brute_kernel(a, b):
    """Sum over pairs of equal subsequences of DECAY ** (spans)."""
    from itertools import combinations

    total = 0.0
    for x in combinations(range(len(a)), toxicity.LENGTH):
        for y in combinations(range(len(b)), toxicity.LENGTH):
            if all(a[i] == b[j] for i, j in zip(x, y)):
                total += toxicity.DECAY ** (x[-1] - x[0] + 1 + y[-1] - y[0] + 1)
    return total


def test_kernel_equals_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(14)] + ["idiot", "ixdiot", "id"]
    got = toxicity.kernel(words, words)
    own = toxicity.self_kernel(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(brute_kernel(a, b), rel=1e-4, abs=1e-6)
        assert own[i] == pytest.approx(got[i, i], rel=1e-4, abs=1e-6)


def toxic_rows(n, seed):
    rng = random.Random(seed)
    syllables = ["the", "and", "er", "ti", "on", "an", "sh", "wh", "lo", "ma"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        text = [word() for _ in range(40)]
        if i % 3 == 0:
            bad = rng.choice(["idiot", "moron", "scum"])
            k = rng.randint(1, len(bad) - 1)
            bad = rng.choice([bad, bad[:k] + rng.choice("xqz") + bad[k:], bad])
            text[rng.randint(1, 38)] = bad
        out.append((" ".join(text) + ".", int(i % 3 == 0)))
    return out


def test_toxicity_on_held_out_sentences(spark, edge):
    model = toxicity.train(toxic_rows(900, 1))
    test = toxic_rows(300, 2)
    value = toxicity.Scorer(model).texts([t for t, _ in test])[0] > 0
    truth = np.array([bool(y) for _, y in test])
    assert (value & truth).sum() / truth.sum() > 0.9 and (value & ~truth).sum() == 0
    assert toxicity.words_of("You i d i o t! m.o.r.o.n a b") >= {"idiot", "moron"}
    got = toxicity.score(edge, model)
    assert got.count() == len(EDGE) + 1
    assert got.where("doc_id in (0, 1, 2)").select("toxicity").distinct().first()[0] == toxicity.NO_WORDS
    assert toxicity.clean(edge, model).columns == edge.columns
    empty = toxicity.fit(edge, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(edge, empty).where("toxic").count() == 0


# -- quality


def python_statistics(text):
    t = " ".join(text.split())
    w, lines = t.split(" ") if t else [], [x.strip() for x in text.split("\n") if x.strip()]
    return len(w), len(set(w)) / len(w) if w else 0, (len(lines) - len(set(lines))) / len(lines) if lines else 0


def test_quality_statistics_rules_and_edges(spark, edge):
    got = {r["doc_id"]: r["_s"] for r in quality.statistics(edge).collect()}
    for i, t in enumerate(EDGE):
        n, distinct, repeated = python_statistics(t or "")
        assert got[i]["n_words"] == n and got[i]["distinct_words"] == round(distinct, 6) and (not n or got[i]["repeated_lines"] == round(repeated, 6))
    rng = random.Random(3)
    texts = [" ".join(rng.choice(EN.split()) + ("$$$" if k % 5 == 0 else "") for _ in range(30)) for k in range(200)]
    docs = spark.createDataFrame(rows(texts), DOCS)
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    assert 1 <= len(rules) <= 3
    scored = {r["doc_id"]: r for r in quality.score(docs, rules).collect()}
    assert sum(scored[k]["quality"] == int(k % 5 != 0) for k in range(200)) >= 198
    # The expression decides as the rules do by themselves.
    x = np.array([[scored[k][f] for f in quality.FEATURES] for k in range(200)])
    first = np.full(200, -1)
    for i, r in reversed(list(enumerate(rules, 1))):
        first[quality._holds(r, x)] = i
    assert [scored[k]["rule_no"] for k in range(200)] == first.tolist()
    edges = {r["doc_id"]: r for r in quality.score(edge, rules).collect()}
    assert [edges[i]["rule"] for i in (0, 1, 2)] == ["no text"] * 3 and len(edges) == len(EDGE) + 1
    assert quality.good(edge, []).columns == edge.columns and quality.good(edge, []).count() == len(EDGE) - 2
    assert quality.fit(edge.limit(0), labels) == []


# -- pages


def test_rendering():
    page = """<html><head><title>x</title><style>.ad{display:none}</style><body><h1>Hi  there</h1><p>One<p>Two <b>bold</b> &amp; x<br>line
    <ul><li>a<li>b<ol><li>n1<li>n2</ol><li>c</ul><div class=ad>AD</div><div hidden>H</div><div style="visibility:hidden">no<span style="visibility:visible">yes</span></div>
    <table><tr><th>Name<th>Val<tr><td>long name<td>3</table><pre>a\n  b</pre><script>var t="</p>";</script>1 < 2"""
    assert html_text.render(page) == "\n".join(
        ["Hi there", "", "One", "", "Two bold & x", "line", "", "- a", "- b", "  1. n1", "  2. n2", "- c", "", "yes", "", "Name       Val", "long name  3", "", "a", "  b", "", "1 < 2"]
    )


@pytest.mark.parametrize("page", ["", "<", "<a", '<a href="', "</p></div>", "<!--", "<script>", "<table>", "<td>x</td>", "<li>", "&", "<p" * 50, "<div>" * 3000, '<a "' * 3000, "<table><tr><td>" * 300 + "x"])
def test_rendering_never_fails(page):
    assert isinstance(html_text.render(page), str)


def test_pages_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<p>" + "b " * 100_000)], "page_id long, html string")
    got = html_text.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"] if r["text"] is None else len(r["text"])) for r in got if r["page_id"] != 1) == [(0, 199_999), (2, 0), (3, 1), (3, 1)]
    assert [r["text"] for r in got if r["page_id"] == 1] == [None]


# -- chats


def test_chats(spark):
    turns = [(1, 2, "Assistant ", "b"), (1, 1, "user", "a<|x"), (1, 3, "assistant", " c "), (1, 3, "assistant", " c "), (2, 0, None, None), (None, 1, None, "z"), (3, None, "user", "n"), (3, 0, "user", "m")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[1]["chat"] == "<|user|>\na<\\|x\n<|end|>\n<|assistant|>\nb\n\nc\n\nc\n<|end|>" and got[1]["n_messages"] == 2 and got[1]["n_turns"] == 4
    assert got[2]["chat"] == "" and got[2]["n_turns"] == 0
    assert got[None]["chat"] == "<|user|>\nz\n<|end|>"
    assert got[3]["chat"] == "<|user|>\nn\n\nm\n<|end|>"
    assert chat.format_chats(df.limit(0)).count() == 0


# -- tokens


def test_tokens_equal_a_public_encoder_and_decode(spark, edge):
    params = bpe.BpeParams()
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(params.ranks), special_tokens={})
    texts = [*EDGE[:-1], "a" * 60, "it's  we'll x\n\n 12 ª́ <|endoftext|>", "\x00\x1f​ ﻿"]
    docs = spark.createDataFrame(rows(texts), DOCS)
    got = {r["doc_id"]: r for r in bpe.tokens(docs, params).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["ids"] is None and got[i]["n_tokens"] == 0 and got[i]["round_trip"] is None
        else:
            assert got[i]["ids"] == own.encode_ordinary(t) and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["round_trip"]
    assert bpe.tokens(docs.limit(0), params).count() == 0
    odd = spark.createDataFrame([([100_000, None, 72],)], "ids array<int>").select(bpe.decode("ids", params).alias("t")).first()[0]
    assert odd == bytes(next(p for p, r in bpe.load_ranks(params.ranks).items() if r == 72)).decode()
