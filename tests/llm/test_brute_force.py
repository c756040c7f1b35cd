"""Queries of operators that SQL can't express, and the pipeline's stages, against plain Python on small fixtures."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)
from tests.llm.test_corpus import DOCS, documents, roots, words  # noqa: E402
from tests.llm.test_row_local import DE, EN, brute_kernel, ppm_cost, toxic_rows  # noqa: E402
from weftline.llm import bpe, html_text, langid, mixing, simhash, toxicity  # noqa: E402


def drawn(spark, docs, params):
    """doc_id -> shard of the drawn documents, from the hashes of the rows alone."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit(mixing.UNKNOWN)).alias("source"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("doc_id", "text", F.lit(params.seed)).alias("draw")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sizes = {s: len(v) for s, v in by.items()}
    want = mixing.quotas(sizes, params)
    order, shards = sorted(want), max(1, -(-sum(r["size"] for r in rows) // params.shard_bytes))
    total = sum(sizes[s] for s in order)
    rng = np.random.default_rng(params.seed)
    taken, blocks = [], []
    for s in order:
        n = max(1, round(params.blocks_per_shard * shards * sizes[s] / total))
        place = {int(b): k for k, b in enumerate(rng.permutation(n))}
        # A block's number is the high part of the unsigned hash; the permutation says when its turn comes.
        ranked = sorted((place[(r["draw"] % 2**64 >> 20) % n], r["draw"], r["doc_id"]) for r in by[s])[: want[s]]
        taken.append(ranked)
        blocks.append(ranked[-1][0] + 1 if ranked else 0)
    split = mixing.split(np.array(blocks), shards, rng)
    out = {}
    for j, ranked in enumerate(taken):
        to = np.repeat(np.arange(shards), split[:, j])
        out |= {d: int(to[k]) for k, _, d in ranked}
    return out


@pytest.mark.parametrize("params", [mixing.MixParams(weights={"a": 1, "b": 2, "c": 1}, shard_bytes=3000), mixing.MixParams(weights={"a": 10.0}, other=1.0, keep=0.9, shard_bytes=5000), mixing.PRODUCTION])
def test_mixing_equals_a_plain_draw(spark, params):
    docs = documents(spark, [f"text {i} " + "x" * (i % 50) for i in range(700)] + [None, "", "y" * 200_000], ["a", "a", "a", "b", "b", "c"])
    want = drawn(spark, docs, params)
    got = mixing.mix(docs, params).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want and len(got) == len(want)


def test_mixing_of_rows_without_ids(spark):
    # A third of all rows has no id: they are drawn and spread like any others.
    docs = documents(spark, [f"text number {i}" for i in range(300)], ["a", "b"]).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    got = mixing.mix(docs, mixing.MixParams(weights={"a": 1, "b": 1}, keep=0.5, shard_bytes=1000)).collect()
    assert len(got) == 150 and len({r["shard"] for r in got if r["doc_id"] is None}) > 1


def naive_toxicity(model, text):
    """Score of a text by the definition: its most toxic word, or stretch of a long one."""
    best = toxicity.NO_WORDS
    for w in toxicity.words_of(text or ""):
        x = "^" + w
        k = [brute_kernel(x, "^" + m) / np.sqrt(max(brute_kernel(x, x) * brute_kernel("^" + m, "^" + m), 1e-20)) for m in model.landmarks]
        best = max(best, round(float(np.array(k) ** 2 @ model.weights + model.bias), 4))
    return best


def test_toxicity_query_equals_the_definition(spark):
    model = toxicity.train(toxic_rows(600, 4))
    texts = [t for t, _ in toxic_rows(12, 5)] + [None, "", "...", "you m.o.r.o.n", "x" * 3]
    docs = documents(spark, [" ".join((t or "").split()[:14]) if t else t for t in texts])
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for r in docs.collect():
        want = naive_toxicity(model, r["text"])
        assert got[r["doc_id"]]["toxicity"] == pytest.approx(want, abs=2e-4) and got[r["doc_id"]]["toxic"] == (got[r["doc_id"]]["toxicity"] > 0)
    kept = {r["doc_id"] for r in toxicity.clean(docs, model).collect()}
    assert kept == {d for d, r in got.items() if not r["toxic"]}


def test_remembered_words_are_forgotten_safely(monkeypatch):
    model = toxicity.train(toxic_rows(600, 4))
    texts = [t for t, _ in toxic_rows(120, 6)]
    whole = toxicity.Scorer(model).texts(texts)[0]
    monkeypatch.setattr(toxicity, "REMEMBERED", 40)
    scorer = toxicity.Scorer(model)
    assert np.concatenate([scorer.texts(texts[i : i + 7])[0] for i in range(0, 120, 7)]).tolist() == whole.tolist()


def naive_language(samples, params, text):
    """(language, bits a byte, margin, accepted) by the definition."""
    languages = sorted(samples)
    trees, total = [], defaultdict(int)
    for lang in languages:
        tree = {}
        for order in range(langid.ORDER + 1):
            for t in samples[lang]:
                for i in range(len(t) - order):
                    f = tree.setdefault(t[i : i + order], {})
                    f[t[i + order]] = f.get(t[i + order], 0) + 1
                    total[t[i : i + order]] += 1
        trees.append(tree)
    known = {c for c, n in total.items() if n >= params.min_count} | {b""}
    data = (text or "").encode()
    if not any(ch.isalpha() for ch in text or ""):
        return "und", False
    cost = [ppm_cost(trees, known, data, k) for k in range(len(languages))]
    bits, second = (x / len(data) / langid.SCALE for x in sorted(cost)[:2])
    fine = bits <= params.max_bits_per_byte and second - bits >= params.min_margin
    return (languages[cost.index(min(cost))] if fine else "und"), fine


def test_language_query_equals_the_definition(spark):
    params = langid.LangIdParams(max_contexts=10**9, min_count=1)
    samples = {"de": [(DE * 3).encode()], "en": [(EN * 3).encode()]}
    model = langid.train(samples, params)
    junk = "".join(random.Random(2).choice("0123456789abcdefXYZQJ#~^|") for _ in range(400))
    texts = [EN[:60], DE[:60], "the fuchs springt over", junk, "", None, "12 34", "jumps " * 9]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["pred_lang"], got[i]["accepted"]) == naive_language(samples, params, t), t
    assert not got[3]["accepted"]
    assert {r["doc_id"] for r in langid.accepted(documents(spark, texts), model).collect()} == {i for i in got if got[i]["accepted"]}


def test_planted_junk_is_rejected_and_clean_texts_are_kept(spark):
    rng = random.Random(7)
    clean = [" ".join(words(rng, 60)).capitalize() + "." for _ in range(120)]
    junk = ["".join(rng.choice("0123456789abcdef") for _ in range(500)), "".join(chr(rng.randint(33, 126)) for _ in range(500)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(200)), "zQ9~" * 60]
    # Nobody has labelled the junk.
    docs = documents(spark, clean + junk).withColumn("lang", F.when(F.col("doc_id") < 120, "en"))
    kept = {r["doc_id"] for r in langid.accepted(docs, langid.fit(docs)).collect()}
    assert kept >= set(range(120)) and not kept & {120, 121, 122}


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 300 + "é" * 200, "".join(random.Random(1).choice("acgt") for _ in range(3000)), "x" * 257 + " " + "y" * 256, "word " * 60_000])
def test_very_long_words_and_texts_are_merged_in_full(spark, text):
    params = bpe.BpeParams()
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(params.ranks), special_tokens={})
    got = bpe.tokens(documents(spark, [text]), params).first()
    assert got["ids"] == own.encode_ordinary(text) and got["round_trip"]


def test_words_are_cut_as_the_pattern_says():
    import regex

    rng = random.Random(1)
    parts = ["a", "B", "é", "1", "²", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'d", "!", "中", "_", "'ve", "'m", "'t", "ª", chr(0x308), chr(0xA0), chr(0x85), "\x1c", chr(0x1F600), chr(0x2028)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + [None, ""]
    flat, counts = bpe.cut_words(pa.array(texts))
    flat, at, pattern = flat.to_pylist(), 0, regex.compile(bpe.PATTERN)
    for t, n in zip(texts, counts.tolist()):
        assert flat[at : at + n] == (pattern.findall(t) if t else [])
        at += n


def test_pages_edges_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b", "x", "y")], "page_id long, html string, text string, n_lines string")
    got = html_text.extract(pages)
    assert [(r["page_id"], r["text"], r["n_lines"]) for r in got.collect()] == [(1, html_text.render("<p>a<p>b"), 3)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_every_stage_of_the_pipeline_against_plain_decisions(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(words(rng, 80)) + "." for _ in range(90)]
    texts += [texts[0], texts[1].replace("the", "th", 1), None, "", "!!!", "x" * 70_000 + " " + texts[2], texts[3] + " " + texts[4] * 40]
    docs = documents(spark, texts, ["a", "b"]).union(documents(spark, [texts[5], " ".join(words(rng, 50))]).withColumn("doc_id", F.lit(None).cast("long"))).union(documents(spark, texts[:1]))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    toxic = toxic_rows(0, 1)
    assert toxic == []
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "")
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = step.collect()
        out = stage(spark, step, str(tmp_path)).collect()
        if name == "language_id":
            fine = langid.decide(langid.fit(step), pa.array([r["text"] for r in before], pa.string()))[3]
            want = sorted(key(r) for r, f in zip(before, fine) if f)
        elif name == "toxicity":
            model = toxicity.fit(step, spark.read.parquet(str(tmp_path / "labels.parquet")))
            want = sorted(key(r) for r in before if not len(model.weights) or naive_toxicity(model, r["text"]) <= 0)
        elif name == "simhash_near_dedup":
            sizes, lanes = simhash.signatures_of(pa.array([r["text"] for r in before], pa.string()))
            ids = [i for i, r in enumerate(before) if r["doc_id"] is not None and sizes[i]]
            pairs = [(i, j) for i in ids for j in ids if i < j and (before[i]["doc_id"] == before[j]["doc_id"] or simhash.distances(lanes[i], lanes[j]) <= simhash.SimHashParams().max_distance)]
            root = roots(ids, pairs)
            least = defaultdict(lambda: 10**9)
            for i in ids:
                least[root[i]] = min(least[root[i]], before[i]["doc_id"])
            want = sorted({key(r) for i, r in enumerate(before) if i not in root or r["doc_id"] == least[root[i]]})
        elif name == "mixing":
            shard = drawn(spark, step, mixing.PRODUCTION)
            want = sorted(key(r) for r in before if r["doc_id"] in shard)
        else:
            own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.BpeParams().ranks), special_tokens={})
            assert sorted((key_id(r["doc_id"]), r["ids"]) for r in out) == sorted((key_id(r["doc_id"]), own.encode_ordinary(r["text"])) for r in before) and all(r["round_trip"] for r in out)
            break
        assert sorted(map(key, out)) == want, name
        step = spark.createDataFrame(out, DOCS)
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((key_id(r["doc_id"]), r["ids"]) for r in ran) == sorted((key_id(r["doc_id"]), r["ids"]) for r in out)


def key_id(i):
    return -1 if i is None else i
