"""Operator 3: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source has a quota of documents in proportion to its target weight, drawn without replacement. With ``keep``, the
mixture is that part of all weighted documents: a source that can't fill its share gives all it has, and the rest is
apportioned over the others by their weights. Without it, the shares are exact and the mixture is as large as the
scarcest source allows. ``PRODUCTION`` is what the query and the pipeline use. A source's documents fall into blocks by a hash; blocks are numbered in a random
permutation, and those that hold the quota are drawn, the last one in part, so that the quota is exact. A tree then
splits the drawn blocks among the output shards: at each node the vector of block quotas of all sources is divided by
one multivariate-hypergeometric draw, so that both halves have exactly the blocks that their shards need, down to single
shards. A shard takes the next blocks of each source's permutation, which makes the draws disjoint, and shuffles its
documents locally. Text moves once, to its shard.

Only counts by (source, block) come to the driver, as arrays. There are ``blocks_per_shard`` blocks for each shard, and a
shard holds about ``shard_bytes`` of text: with 100 TB that is some 26 million counts of 16 bytes.

Defined results:
- a null source is a source of its own, named ``unknown`` for weights; a null text is a document like any other, and so are
  an empty one and a very long one, which is drawn whole and counts as one document of its source;
- rows with the same id and text are drawn or left together; a quota is exact but for such rows at its edge, of which all
  are drawn; ties of the local order are broken by id;
- a source without a weight has weight ``other``; one with weight 0 is left out; sources that have a weight but no document are ignored;
- an empty table gives no rows; other columns pass through unchanged, and the added columns replace any of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import BROADCAST_LIMIT_BYTES

UNKNOWN = "unknown"


@dataclass(frozen=True)
class MixParams:
    """weights: by source; None gives every source its size to the power ``temperature``. other: of sources not in weights.

    keep: part of the weighted documents to draw; None draws the largest mixture with exact shares."""

    weights: dict[str, float] | None = field(default=None, hash=False)
    other: float = 0.0
    keep: float | None = None
    temperature: float = 0.7
    shard_bytes: int = 32 << 20
    blocks_per_shard: int = 8
    seed: int = 20_240_601


#: Target weights of the registered query and the pipeline: the general source ten times any other, which all are equal.
PRODUCTION = MixParams(weights={"src0": 10.0}, other=1.0, keep=0.9)


def quotas(sizes: dict[str, int], params: MixParams) -> dict[str, int]:
    """Documents to draw from each source: shares of the mixture, rounded by largest remainder."""
    weight = {s: n**params.temperature for s, n in sizes.items()} if params.weights is None else {s: float(params.weights.get(s, params.other)) for s in sizes}
    weight = {s: w for s, w in weight.items() if w > 0 and sizes[s] > 0}
    if not weight:
        return {}
    total = sum(weight.values())
    if params.keep is None:
        size = min(int(sizes[s] * total / w + 1e-9) for s, w in weight.items())
    else:
        size = min(sum(sizes[s] for s in weight), math.ceil(params.keep * sum(sizes[s] for s in weight)))
    out: dict[str, int] = {}
    # Sources that can't fill their share give all; that raises the others' shares, until all that are left can.
    while params.keep is not None and (short := [s for s, w in weight.items() if size * w >= sizes[s] * total]):
        for s in short:
            out[s] = sizes[s]
            size -= sizes[s]
            del weight[s]
        if not weight:
            return out
        total = sum(weight.values())
    share = {s: size * w / total for s, w in weight.items()}
    part = {s: min(sizes[s], int(x)) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s)):
        if sum(part.values()) >= size:
            break
        if part[s] < sizes[s]:
            part[s] += 1
    return out | part


def split(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many blocks of each source every shard gets. Row sums differ by at most one, column sums are ``blocks``."""
    out = np.zeros((shards, len(blocks)), np.int64)
    stack = [(0, shards, blocks.astype(np.int64))]
    while stack:
        low, high, have = stack.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        total = int(have.sum())
        # Blocks of the left half: its share of shards, the odd ones spread by position.
        left = total * (middle - low) // (high - low)
        # "count" draws are exact for any total; "marginals" is used where the totals are large.
        drawn = rng.multivariate_hypergeometric(have, left, method="marginals") if total else np.zeros_like(have)
        stack += [(low, middle, drawn), (middle, high, have - drawn)]
    return out


def _small(side: DataFrame, size: int) -> DataFrame:
    """A join side of ``size`` bytes, sent to all executors only below the limit; beyond it the join is by shuffle."""
    return F.broadcast(side) if size <= BROADCAST_LIMIT_BYTES else side


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The drawn rows of ``docs`` with ``shard`` and ``shard_pos``; physically one shard after another, shuffled within."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "shard_pos")]
    # Columns go by position, so that no name of theirs meets one of ours.
    names = [f"c{i}" for i in range(len(kept))]
    source, by_id, text = F.coalesce(F.col("source"), F.lit(UNKNOWN)), F.col("doc_id"), F.col("text")
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], source.alias("_source"), by_id.alias("_id"), F.xxhash64(by_id, text, F.lit(params.seed)).alias("_draw"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"))
    sized = docs.groupBy("_source").agg(F.count("*").alias("n"), F.sum("_bytes").alias("bytes")).collect()
    sizes = {r["_source"]: r["n"] for r in sized}
    want = quotas(sizes, params)
    if not sum(want.values()):
        return docs.select(*names, F.lit(0).alias("shard"), F.lit(0).alias("shard_pos")).where(F.lit(False)).toDF(*kept, "shard", "shard_pos")
    shards = int(max(1, -(-sum(r["bytes"] for r in sized) // params.shard_bytes)))
    order = sorted(want)
    total = sum(sizes[s] for s in order)
    count = np.array([max(1, round(params.blocks_per_shard * shards * sizes[s] / total)) for s in order])
    # Each source gets a number and its count of blocks by a join with a table of the sources.
    table = spark.createDataFrame(pa.table({"_source": order, "_code": pa.array(range(len(order)), pa.int32()), "_blocks": pa.array(count, pa.int64())}))
    # The high part of a row's hash picks the block, the whole orders documents in it.
    placed = docs.join(_small(table, len(order) * 64), "_source").withColumn("_block", F.pmod(F.shiftrightunsigned("_draw", 20), F.col("_blocks")).cast("int"))
    counted = placed.groupBy("_code", "_block").agg(F.count("*").alias("n")).toArrow()
    codes, blocks, sums = (counted.column(i).to_numpy() for i in range(3))
    first = np.concatenate([[0], np.cumsum(count)])
    have = np.zeros(first[-1], np.int64)
    have[first[codes] + blocks] = sums
    rng = np.random.default_rng(params.seed)
    taken: list[np.ndarray] = []
    edges: list[tuple[int, int, int]] = []  # (source, block drawn in part, documents of it)
    for j, s in enumerate(order):
        permuted = rng.permutation(count[j])
        filled = np.cumsum(have[first[j] : first[j + 1]][permuted])
        k = int(np.searchsorted(filled, want[s], "left"))
        taken.append(permuted[: k + 1] if want[s] else permuted[:0])
        if want[s] and filled[k] > want[s]:
            edges.append((j, int(permuted[k]), int(want[s] - (filled[k - 1] if k else 0))))
    per_shard = split(np.array([len(t) for t in taken]), shards, rng)
    plan = {
        "_code": np.repeat(np.arange(len(order)), [len(t) for t in taken]).astype(np.int32),
        "_block": np.concatenate(taken).astype(np.int32),
        "_shard": np.concatenate([np.repeat(np.arange(shards), per_shard[:, j]) for j in range(len(order))]).astype(np.int32),
    }
    rows = spark.createDataFrame(pa.table(plan))
    # The cut of a block drawn in part is the hash of its last document: a running count over the block's hashes, each with its rows.
    edge = spark.createDataFrame(edges, "_code int, _block int, _need long")
    running = F.sum("n").over(Window.partitionBy("_code", "_block").orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0))
    partly = placed.select("_code", "_block", "_draw").join(_small(edge, len(edges) * 32), ["_code", "_block"]).groupBy("_code", "_block", "_draw", "_need").agg(F.count("*").alias("n")).withColumn("_sum", running)
    cut = partly.where("_sum >= _need").groupBy("_code", "_block").agg(F.min("_draw").alias("_cut"))
    size = len(plan["_code"]) * 32
    drawn = placed.join(_small(rows.join(_small(cut, len(edges) * 32), ["_code", "_block"], "left"), size), ["_code", "_block"]).where(F.col("_cut").isNull() | (F.col("_draw") <= F.col("_cut")))
    drawn = drawn.select(*names, "_id", "_shard", "_draw", F.xxhash64("_draw", F.lit(params.seed + 1)).alias("_local"))
    # One shard a task. The position is a running number in the shard: the window needs its rows together and sorted, as they are wanted.
    placed = drawn.repartitionById(shards, F.col("_shard"))
    return placed.select(*names, F.col("_shard").alias("shard"), (F.row_number().over(Window.partitionBy("_shard").orderBy("_local", "_id")) - 1).alias("shard_pos")).toDF(*kept, "shard", "shard_pos")


def mixed(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The drawn rows with the columns of ``docs`` only."""
    return mix(docs, params).select(*docs.columns)
