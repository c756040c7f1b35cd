"""Operators that look at the whole table: near-duplicates, mixing, language model, and the pipeline."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)
from weftline.llm import batches, embdedup, lm, mixing, simhash  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, key string"


def documents(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)] if sources else "s", len(t) if t else 0, "x", "y") for i, t in enumerate(texts)], DOCS)


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def words(rng, n):
    return ["".join(rng.choice(["the", "an", "er", "ti", "on", "sh", "wh", "lo"]) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for k in range(60):
        base = words(rng, 120)
        texts.append(" ".join(base))
        for _ in range(k % 4):
            copy = list(base)
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            texts.append(" ".join(copy))
    texts += [None, "", "!!", "!!", texts[0], texts[0]]
    docs = documents(spark, texts).union(documents(spark, ["no id"]).selectExpr("cast(null as long)", "text", "lang", "source", "n_chars", "node", "key"))
    sizes, lanes = simhash.signatures_of(pa.array(texts))
    limit = simhash.SimHashParams().max_distance
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sizes[i] and sizes[j] and simhash.distances(lanes[i], lanes[j]) <= limit]
    want = roots(range(len(texts)), pairs)
    got = {r["doc_id"]: r for r in simhash.groups(docs).collect()}
    near = [(i, j) for i, j in pairs if simhash.distances(lanes[i], lanes[j]) <= 2 * simhash.SEGMENTS - 1]
    assert len(near) > 20 and all(got[i]["keep_id"] == got[j]["keep_id"] for i, j in near)
    found = sum(got[i]["keep_id"] == got[j]["keep_id"] for i, j in pairs)
    assert found / len(pairs) >= 0.9 and all(want[i] == want[got[i]["keep_id"]] for i in want)
    count = Counter(r["keep_id"] for r in got.values())
    assert all(r["group_size"] == count[r["keep_id"]] for r in got.values())
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["keep_id"] for r in got.values()} | {None}
    assert simhash.groups(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0


def test_simhash_recall_by_distance(spark):
    rng = np.random.default_rng(8)
    distances, each = (15, 20, 24, 28, 32), 400
    rows, node = [], 0
    for d in distances:
        for _ in range(each):
            bits = rng.integers(0, 2, simhash.BITS, dtype=np.uint8)
            other = bits.copy()
            other[rng.choice(simhash.BITS, d, replace=False)] ^= 1
            lanes = np.packbits(np.stack([bits, other]), axis=1).view(">i8").astype(np.int64)
            rows += [(node, *lanes[0].tolist()), (node + 1, *lanes[1].tolist())]
            node += 2
    nodes = spark.createDataFrame(rows, "node long, " + ", ".join(f"{n} long" for n in simhash.LANE_NAMES))
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(nodes, simhash.SimHashParams()).collect()}
    recall = {d: sum((a, a + 1) in got for a in range(2 * each * k, 2 * each * (k + 1), 2)) / each for k, d in enumerate(distances)}
    assert all(b == a + 1 and a % 2 == 0 for a, b in got)
    assert recall[15] == 1 and recall[20] >= 0.99 and recall[24] >= 0.99 and recall[28] >= 0.97 and recall[32] >= 0.9, recall


@pytest.mark.parametrize("bucket_rows", [1 << 14, 64])
def test_simhash_loses_no_pair_within_the_limit(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows, raising=False)
    rng = np.random.default_rng(3)
    limit, signs = simhash.SimHashParams().max_distance, []
    for d in (1, 16, 24, 31, limit, limit + 1):
        for k in range(120):
            bits = rng.integers(0, 2, simhash.BITS, dtype=np.uint8)
            other = bits.copy()
            # At random places, and spread evenly so that no segment is spared.
            other[rng.choice(simhash.BITS, d, replace=False) if k % 2 else (np.arange(d) * simhash.BITS // d + k) % simhash.BITS] ^= 1
            signs += [bits, other]
    # A large cluster, whose members needn't all be near each other, and equal parts that make buckets hot.
    cluster = np.repeat(rng.integers(0, 2, (1, simhash.BITS), dtype=np.uint8), 150, axis=0)
    for row in cluster:
        row[rng.choice(simhash.BITS, 18, replace=False)] ^= 1
    hot = rng.integers(0, 2, (200, simhash.BITS), dtype=np.uint8)
    hot[:, :64] = 1
    lanes = np.packbits(np.concatenate([np.stack(signs), cluster, hot]), axis=1).view(">i8").astype(np.int64)
    nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(lanes.tolist())], "node long, " + ", ".join(f"{n} long" for n in simhash.LANE_NAMES))
    got = [(r["a"], r["b"]) for r in simhash.near_pairs(nodes, simhash.SimHashParams()).collect()]
    want = [(a, b) for a in range(len(lanes)) for b in (a + 1 + np.flatnonzero(simhash.distances(lanes[a + 1 :], lanes[a]) <= limit)).tolist()]
    assert set(got) <= set(want) and len(got) == len(set(got))
    assert roots(range(len(lanes)), got) == roots(range(len(lanes)), want)


def test_repeated_ids_keep_one_row(spark):
    docs = documents(spark, ["one two three four"]).union(documents(spark, ["one two three four"]))
    assert simhash.deduplicate(docs).count() == 1


def test_deletion_keys_meet_within_one_bit():
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, (1, simhash.LANES), dtype=np.int64)
    for bit in range(64):
        b = a.copy()
        b[0, 0] = np.uint64(np.uint64(a[0, 0].view(np.uint64)) ^ np.uint64(1 << bit)).view(np.int64)
        assert set(simhash.deletion_keys(a)[0].tolist()) & set(simhash.deletion_keys(b)[0].tolist())


def test_mixture_is_exact_and_disjoint(spark):
    docs = documents(spark, [f"text {i} " + "x" * (i % 50) for i in range(900)], ["a", "a", "a", "b", "b", "c"])
    params = mixing.MixParams(weights={"a": 1, "b": 2, "c": 1, "none": 5}, shard_bytes=4000)
    want = mixing.quotas({"a": 450, "b": 300, "c": 150}, params)
    assert want == {"a": 150, "b": 300, "c": 150}
    got = mixing.mix(docs, params).collect()
    assert Counter(r["source"] for r in got) == want and len({r["doc_id"] for r in got}) == len(got)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["shard_pos"])
    assert len(shards) > 1 and all(sorted(p) == list(range(len(p))) for p in shards.values())
    again = mixing.mix(docs.repartition(7), params).collect()
    assert {(r["doc_id"], r["shard"], r["shard_pos"]) for r in got} == {(r["doc_id"], r["shard"], r["shard_pos"]) for r in again}


def test_scarce_source_gives_all_and_the_rest_is_apportioned(spark):
    sizes = {f"s{i:02}": 500_000 for i in range(20)} | {mixing.UNKNOWN: 1}
    want = mixing.quotas(sizes, mixing.PRODUCTION)
    assert want[mixing.UNKNOWN] == 1 and sum(want.values()) == -(-sum(sizes.values()) * 9 // 10)
    assert max(n for s, n in want.items() if s != mixing.UNKNOWN) - min(n for s, n in want.items() if s != mixing.UNKNOWN) <= 1
    assert mixing.quotas({"a": 100, "b": 10, "c": 100}, mixing.MixParams(weights={"a": 1, "b": 5, "c": 2}, keep=0.5)) == {"a": 32, "b": 10, "c": 63}
    hot = mixing.quotas({"src0": 95_000} | {f"src{i}": 5_000 for i in range(1, 20)}, mixing.PRODUCTION)
    assert hot["src0"] >= 0.75 * 95_000 and all(hot[f"src{i}"] == 5_000 for i in range(1, 20))
    docs = documents(spark, [f"text {i}" for i in range(400)], ["a", "b"]).union(spark.createDataFrame([(999, "stray", "en", None, 5, "x", "y")], DOCS))
    got = mixing.mix(docs, mixing.PRODUCTION).collect()
    assert Counter(r["source"] for r in got) == {"a": 180, "b": 180, None: 1}


def test_splitting_tree_sums():
    rng = np.random.default_rng(3)
    blocks = np.array([40, 7, 0, 13])
    out = mixing.split(blocks, 7, rng)
    assert out.sum(axis=0).tolist() == blocks.tolist() and np.ptp(out.sum(axis=1)) <= 1 and (out >= 0).all()


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, "x", "y"), (1, "", None, "a", 0, "x", "y"), (1, "", None, "a", 0, "x", "y")], DOCS)
    got = mixing.mix(docs, mixing.MixParams(temperature=1.0))
    assert got.count() == 3 and mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs, mixing.MixParams(weights={})).count() == 0
    clash = docs.withColumn("shard", docs.doc_id).withColumn("_block", docs.doc_id)
    assert mixing.mix(clash, mixing.MixParams(temperature=1.0)).columns == [*docs.columns, "_block", "shard", "shard_pos"]


def test_embedding_groups_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32))
    x = np.vstack([base, base[:80] + 0.18 * rng.standard_normal((80, 32)), base[:40] + 0.05 * rng.standard_normal((40, 32)), base[:5]]).astype(np.float32)
    table = spark.createDataFrame(
        [(i, v.tolist(), 0, "n") for i, v in enumerate(x)] + [(1000, None, 0, "n"), (1001, [], 0, "n"), (1002, [0.0] * 32, 0, "n"), (1003, [float("nan")] * 32, 0, "n"), (1004, [1.0], 0, "n"), (1005, [1.0], 0, "n"), (None, [1.0] * 32, 0, "n"), (0, x[0].tolist(), 0, "n")],
        "vec_id long, embedding array<float>, label int, node string",
    )
    unit = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    limit = embdedup.EmbeddingParams().min_cosine
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= limit, 1)))]
    got = {r["vec_id"]: r["keep_id"] for r in embdedup.groups(table).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) / len(pairs) >= 0.9 and len(pairs) > 60
    want = roots(range(len(x)), pairs)
    assert all(want[i] == want[got[i]] for i in range(len(x)))
    assert got[1004] == got[1005] == 1004 and all(got[i] == i for i in (1000, 1001, 1002, 1003)) and None not in got
    assert embdedup.groups(table.limit(0)).count() == 0


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(words(rng, 60)) + "." for _ in range(80)] + ["", None, "unique zebra!!"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in lm.perplexity(docs, lm.LmParams(bucket_bytes=4000)).collect()}
    count, read = Counter(), {}
    for i, t in enumerate(texts):
        if t is not None:
            read[i] = ["<s>", *lm.TOKEN.findall(t.lower()), "</s>"]
            count.update(zip(read[i], read[i][1:]))
    of = Counter(count.values())
    high = lm.discounts(*(of[k] for k in (1, 2, 3, 4)))
    followed, kinds, follows = Counter(), defaultdict(lambda: [0] * 4), Counter()
    for (u, v), n in count.items():
        followed[u] += n
        kinds[u][min(n, 3)] += 1
        follows[v] += 1
    of = Counter(follows.values())
    low = lm.discounts(*(of[k] for k in (1, 2, 3, 4)))
    types, size = sum(follows.values()), len(set(follows) | set(followed))
    rest = sum(low[min(n, 3)] for n in follows.values()) / types
    one = {v: (n - low[min(n, 3)]) / types + rest / size for v, n in follows.items()}
    for i, w in read.items():
        p = [(count[u, v] - high[min(count[u, v], 3)]) / followed[u] + sum(high[k] * kinds[u][k] for k in (1, 2, 3)) / followed[u] * one[v] for u, v in zip(w, w[1:])]
        assert got[i]["log_prob"] == pytest.approx(float(np.log2(p).sum()), abs=1e-3) and got[i]["n_tokens"] == len(p)
    assert got[81]["log_prob"] is None and got[81]["n_tokens"] == 0
    # The probabilities of what may follow a word sum to one, with the unknown word's share.
    for u in list(followed)[:5]:
        total = sum((count[u, v] - high[min(count[u, v], 3)]) / followed[u] for v in follows if count[u, v]) + sum(high[k] * kinds[u][k] for k in (1, 2, 3)) / followed[u]
        assert total == pytest.approx(1)
    assert lm.perplexity(docs.limit(0)).count() == 0


def test_embeddings_of_every_length_are_searched(spark):
    rng = np.random.default_rng(6)
    rows, copies = [], []
    for size, n, near in ((32, 200, 20), (48, 120, 40), (16, 12, 6)):
        base = rng.standard_normal((n, size))
        first = len(rows)
        rows += [(first + i, v.tolist()) for i, v in enumerate(base)]
        copies += [(first + i, len(rows) + i) for i in range(near)]
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(base[:near] + 0.05 * rng.standard_normal((near, size)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["keep_id"] for r in embdedup.groups(table).collect()}
    assert len(got) == len(rows) and all(got[a] == got[b] for a, b in copies)
    assert len(set(got.values())) == 332


def test_language_model_takes_few_bytes_a_run(spark):
    rng = random.Random(2)
    texts = [" ".join(f"{w}{rng.randint(0, 40)}" for w in words(rng, 300)) for _ in range(60)]
    model = lm.train(documents(spark, texts), lm.PRODUCTION)
    read = [["<s>", "<s>", *lm.TOKEN.findall(t), "</s>"] for t in texts]
    pairs, triples = ({g for w in read for g in zip(*(w[i:] for i in range(k)))} for k in (2, 3))
    stored = sum(p.stat().st_size for folder in model.grams for p in Path(folder).iterdir())
    # Pairs count as runs and again as contexts.
    assert stored < 7 * len(pairs) + 7 * len(triples) + 10 * len(pairs) + 4096


def test_short_store_finds_what_was_put(tmp_path):
    hashstore = pytest.importorskip("weftline.llm.hashstore")
    rng = np.random.default_rng(4)
    for bits, size in ((0, 3), (3, 20_000), (16, 1)):
        folder = str(tmp_path / str(bits))
        Path(folder).mkdir()
        keys = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        counts = np.where(rng.random(len(keys)) < 0.1, rng.integers(250, 2**40, len(keys)), rng.integers(1, 5, len(keys)))
        bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
        for number in np.unique(bucket).tolist():
            hashstore.put_short(folder, "key", number, bits, keys[bucket == number], {"n": counts[bucket == number]})
        asked = np.unique(np.concatenate([keys[::2], rng.integers(0, 2**64, 500, dtype=np.uint64)]))
        store, got = hashstore.ShortStore(folder, "key", bits), {}
        for number, which, at in store.find(asked):
            got |= dict(zip(asked[which].tolist(), store.values("n", number, at).tolist()))
        assert got == dict(zip(keys[::2].tolist(), counts[::2].tolist()))


def test_scoring_looks_each_word_of_a_slice_up_once(spark, monkeypatch):
    hashstore = pytest.importorskip("weftline.llm.hashstore")
    rng = random.Random(8)
    texts = [" ".join(words(rng, 50)) for _ in range(40)]
    scorer = lm.Scorer(lm.train(documents(spark, texts), lm.PRODUCTION))
    asked, find = Counter(), hashstore.Store.find

    def counted(store, keys):
        asked[store.folder] += len(keys)
        return find(store, keys)

    monkeypatch.setattr(hashstore.Store, "find", counted)
    scorer.texts(pa.array(texts))
    # Beside the words themselves the end mark and the start mark.
    assert asked[scorer.model.words] == len({w for t in texts for w in lm.TOKEN.findall(t)}) + 2


def test_keys_of_stretches_do_not_depend_on_where_they_stand():
    cutting = pytest.importorskip("weftline.llm.cutting")
    parts = [b"to", b"x" * 70_000, b"be", b"y" * 200_000, b"to", b"\xff", b"x" * 70_000]
    ends = np.cumsum([len(x) + 1 for x in parts])
    high = ends - 1
    got = cutting.keys(np.frombuffer(b" ".join(parts) + b" ", np.uint8), high - [len(x) for x in parts], high).tolist()
    want = []
    for x in parts:
        total, power = 0, int(cutting._BASE)
        for b in x:
            total = (total + int(cutting._BYTE[b]) * power) % 2**64
            power = power * int(cutting._BASE) % 2**64
        want.append(int(cutting.mix(np.array([total ^ len(x)], np.uint64))[0]))
    assert got == want


def test_scoring_in_slices_of_any_size_gives_the_same(spark, monkeypatch):
    rng = random.Random(7)
    docs = documents(spark, [" ".join(words(rng, 50)) for _ in range(40)] + ["", None, "to be or not " * 300])
    want = sorted(map(tuple, lm.perplexity(docs, lm.PRODUCTION).collect()))
    assert lm.SCORED_BYTES > batches.SLICE_BYTES
    monkeypatch.setattr(lm, "SCORED_BYTES", 100)
    assert sorted(map(tuple, lm.perplexity(docs, lm.PRODUCTION).collect())) == want


@pytest.mark.parametrize("order", [3, 4])
def test_perplexity_of_higher_order_equals_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(words(rng, 40)) + "." for _ in range(60)] + ["", None, "unique zebra!!"]
    got = {r["doc_id"]: r for r in lm.perplexity(documents(spark, texts), lm.LmParams(order=order, bucket_bytes=2000)).collect()}
    read = {i: ["<s>"] * (order - 1) + lm.TOKEN.findall(t.lower()) + ["</s>"] for i, t in enumerate(texts) if t is not None}
    count = {order: Counter(tuple(w[j : j + order]) for w in read.values() for j in range(len(w) - order + 1))}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    off = {k: lm.discounts(*(Counter(count[k].values())[m] for m in (1, 2, 3, 4))) for k in count}
    after = defaultdict(list)
    for k in count:
        for g, n in count[k].items():
            after[g[:-1]].append(n)
    size = len({w for r in read.values() for w in r})

    def p(g):
        if not g:
            return 1 / size
        k, ns = len(g), after[g[:-1]]
        n = count[k][g]
        return (n - off[k][min(n, 3)]) / sum(ns) + sum(off[k][min(m, 3)] for m in ns) / sum(ns) * p(g[1:])

    for i, w in read.items():
        logs = [np.log2(p(tuple(w[j : j + order]))) for j in range(len(w) - order + 1)]
        assert got[i]["log_prob"] == pytest.approx(float(sum(logs)), abs=1e-3) and got[i]["n_tokens"] == len(logs)
    assert got[61]["log_prob"] is None


def test_pipeline_on_a_small_folder(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(words(rng, 80)) + "." for _ in range(60)]
    texts += [texts[0], texts[0].replace("the", "th", 1), None, "", "!!!"]
    docs = documents(spark, texts, ["a", "b"])
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert all(r["round_trip"] for r in got) and not ids & {60, 61, 62, 63, 64} and len(ids) == len(got) >= 50
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
