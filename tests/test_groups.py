"""Chains and clusters of many conversations at a time."""

import random

from pyspark.sql import functions as F

from tests.test_messages import PROSE, conversation
from weftline.operators.cluster import cluster, clusters, cosine, entities, tf_idf
from weftline.operators.decisions import annotated, features, ruled
from weftline.operators.flow import flow_chains
from weftline.operators.options import CompressOptions


def slow(texts, threshold):
    """Mergers by a loop over all pairs, each mean worked out anew from sums that mergers add up."""
    vectors, named = tf_idf(texts), [set(entities(t, 100)) for t in texts]
    like = lambda i, j: 0.7 * cosine(vectors[i], vectors[j]) + 0.3 * (len(named[i] & named[j]) / len(named[i] | named[j]) if named[i] | named[j] else 0.0)
    sums = {(i, j): like(min(i, j), max(i, j)) for i in range(len(texts)) for j in range(len(texts)) if i != j}
    groups = {i: [i] for i in range(len(texts))}
    while len(groups) > 1:
        best, pair = -1.0, None
        for i in groups:
            for j in (j for j in groups if j > i):
                mean = sums[i, j] / (len(groups[i]) * len(groups[j]))
                if mean > best + 1e-12:
                    best, pair = mean, (i, j)
        if best < threshold:
            break
        i, j = pair
        groups[i] += groups.pop(j)
        for k in groups.keys() - {i}:
            sums[i, k] += sums[j, k]
            sums[k, i] = sums[i, k]
    out = (sorted(g) for g in groups.values())
    return sorted(g for g in out if len(g) > 1 and g == list(range(g[0], g[0] + len(g))))


def test_clusters_are_those_of_a_loop_over_all_pairs():
    rng = random.Random(3)
    words = "alpha beta gamma delta fetchData Paris London queue worker token".split()
    found = 0
    for n in (2, 3, 7, 20, 40):
        texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 5, 9]))) for _ in range(n)]
        texts[n // 2] = texts[0]
        for threshold in (0.0, 0.15, 0.5):
            want = slow(texts, threshold)
            assert [g for g, _ in cluster(range(n), texts, threshold)] == want
            found += len(want)
    assert found > 5


def test_no_conversation_is_a_python_group_of_its_own(spark):
    texts = ["Can you fix fetchData? " + PROSE * 2, "I've fixed fetchData. " + PROSE * 2, "thanks", PROSE * 3, PROSE * 3 + "More.", "x"]
    one = conversation(spark, texts, ["user", "assistant", "user", "user", "user", "user"])
    many = one.drop("conv_id").crossJoin(spark.range(40).select(F.col("id").alias("conv_id"))).select(*one.columns)
    options = CompressOptions(recency_window=1)
    df = ruled(annotated(features(many, options), options), options)
    for made in (flow_chains(df), clusters(df)):
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
        rows = made.collect()
        assert len({r["conv_id"] for r in rows}) == 40 and len({(r["first"], tuple(r["members"]), r["accepted"], r["reason"], r["tag"]) for r in rows}) == len(rows) / 40
    assert flow_chains(df.limit(0)).count() == 0 and clusters(df.limit(0)).count() == 0
