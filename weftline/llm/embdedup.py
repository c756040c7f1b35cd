"""Operator 4: near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Vectors are scaled to length 1. Their mean and covariance are summed over all rows; from the principal axes, rotations are learned
that bring the rotated vectors close to the corners of a cube: in turn, every vector is quantised to its signs and the
rotation is fitted to them (over all rows, one pass a round). The signs are the code. It is cut into substrings, one a
Hamming table; vectors whose substrings differ by at most one bit meet there, as each substring is indexed once for each
bit deleted. Vectors that meet are compared by their original values: a pair with cosine ``min_cosine`` or more is a near copy.

Substrings are ``spare_bits`` longer than the logarithm of the number of vectors, so that the rows that meet by chance
stay in proportion; the number of tables follows from the chance that a pair at the very threshold meets, so that
``recall`` of such pairs, and more of closer ones, are found at every size. Groups are the connected components; inside
one key's rows a spanning forest of the verified pairs is kept instead of all pairs. Nothing is capped.

Defined results:
- vectors of each length are searched by themselves, with rotations of their own; up to ``FEW`` of a length are all compared;
- null, empty, zero or not finite vectors take part by exact equality only (null ones not at all), and are else their own
  group;
- equal vectors are one group from the start; repeated ids count once, in the smallest of the groups of their vectors;
- rows with a null id give no row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.simhash import _met_again, components
from weftline.runtime import materialize, ship


@dataclass(frozen=True)
class EmbeddingParams:
    min_cosine: float = 0.95
    recall: float = 0.97
    spare_bits: int = 4
    rounds: int = 4
    seed: int = 7


@dataclass
class Codes:
    """Codes are the signs of ``(x - mean) @ axes``; table t has bits ``t * width`` and following."""

    mean: np.ndarray
    axes: np.ndarray
    width: int
    tables: int


#: So many vectors of one length are compared all with all: too few to learn rotations from.
FEW = 64


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """(rows, size) vectors of length 1."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _summed(vectors: DataFrame, size: int, shape: tuple[int, ...], of) -> np.ndarray:
    """The sum of ``of(matrix)`` over all rows, added up in two levels so that little reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                total += of(_matrix(batch.column(0).slice(k, 8192), size))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    rows = vectors.select("embedding").mapInArrow(add, "s binary").repartition(8).mapInArrow(again, "s binary").collect()
    # Sums are rounded so that the order in which tasks end doesn't show.
    return np.round(sum((np.frombuffer(r["s"]).reshape(shape) for r in sorted(rows, key=lambda r: bytes(r["s"]))), np.zeros(shape)), 6)


def learn(vectors: DataFrame, size: int, n: int, params: EmbeddingParams) -> Codes:
    """Rotations from all ``n`` vectors (column ``embedding``, each of ``size`` finite values)."""

    def moments(x: np.ndarray) -> np.ndarray:
        return np.vstack([x.T @ x, x.sum(axis=0)[None]])

    m = _summed(vectors, size, (size + 1, size), moments)
    mean = m[-1] / n
    values, axes = np.linalg.eigh(m[:-1] / n - np.outer(mean, mean))
    axes = axes[:, ::-1]
    # Chance that a bit differs in a pair at the threshold, from the angle around the mean.
    spread = max(1e-9, 1 - float(mean @ mean))
    differ = 2 * np.arcsin(min(1.0, np.sqrt((1 - params.min_cosine) / 2 / spread))) / np.pi
    width = int(np.clip(np.ceil(np.log2(max(2, n))) + params.spare_bits, 8, 48))
    meet = (1 - differ) ** width + width * differ * (1 - differ) ** (width - 1)
    tables = int(np.ceil(np.log(1 - params.recall) / np.log(1 - min(meet, 0.999))))
    number = -(-width * tables // size)
    rng = np.random.default_rng(params.seed)
    turns = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(number)]
    for _ in range(params.rounds):
        stack = np.stack([axes @ r for r in turns])

        def signs(x: np.ndarray, stack=stack) -> np.ndarray:
            c = x - mean
            return np.stack([np.where(c @ a >= 0, 1.0, -1.0).T @ c @ axes for a in stack])

        for k, s in enumerate(_summed(vectors, size, (number, size, size), signs)):
            left, _, right = np.linalg.svd(s)
            turns[k] = (left @ right).T
    return Codes(mean, np.hstack([axes @ r for r in turns])[:, : width * tables], width, tables)


def keys(codes: Codes, x: np.ndarray) -> np.ndarray:
    """(rows, tables * width) int64 keys: each bit deleted from its substring, marked with the bit's number."""
    bits = ((x - codes.mean) @ codes.axes >= 0).reshape(len(x), codes.tables, codes.width)
    place = np.uint64(1) << np.arange(codes.width, dtype=np.uint64)
    whole = (bits * place).sum(axis=2, dtype=np.uint64)
    out = np.empty((len(x), codes.tables, codes.width), np.uint64)
    for bit in range(codes.width):
        low = whole & np.uint64((1 << bit) - 1)
        high = (whole >> np.uint64(bit + 1)) << np.uint64(bit)
        mark = (np.arange(codes.tables, dtype=np.uint64) * np.uint64(codes.width) + np.uint64(bit)) << np.uint64(codes.width)
        out[:, :, bit] = (low | high) | mark
    return out.reshape(len(x), -1).view(np.int64)


def _near(limit: float, size: int):
    def solve(key: np.ndarray, node: np.ndarray, x: np.ndarray, found: set) -> None:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        near = two[(x[two] * x[two + 1]).sum(axis=1) >= limit]
        found.update(zip(np.minimum(node[near], node[near + 1]).tolist(), np.maximum(node[near], node[near + 1]).tolist()))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            unseen = np.arange(s, s + n)
            while len(unseen):
                frontier, unseen = [int(unseen[0])], unseen[1:]
                while frontier and len(unseen):
                    a = frontier.pop()
                    hit = x[unseen] @ x[a] >= limit
                    for b in unseen[hit].tolist():
                        found.add((min(int(node[a]), int(node[b])), max(int(node[a]), int(node[b]))))
                        frontier.append(b)
                    unseen = unseen[~hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, node, embedding) sorted by key; a key's rows may run over several batches."""
        rest: pa.Table | None = None
        found: set[tuple[int, int]] = set()

        def settle(table: pa.Table) -> None:
            if table.num_rows:
                solve(table.column(0).to_numpy(), table.column(1).to_numpy(), _matrix(table.column(2).combine_chunks(), size), found)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            settle(table.slice(0, last))
            rest = table.slice(last)
            if len(found) > 500_000:
                pairs = np.array(sorted(found), np.int64)
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
        if rest is not None:
            settle(rest)
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def near_pairs(vectors: DataFrame, size: int, n: int, params: EmbeddingParams) -> DataFrame:
    """(a, b), a < b: verified pairs, a spanning forest for each key. ``vectors``: (node, embedding)."""
    spark = vectors.sparkSession
    if n <= FEW:
        rows = vectors.select(F.lit(0).cast("long").alias("key"), "node", "embedding").coalesce(1)
        return rows.mapInArrow(_near(params.min_cosine - 1e-9, size), "a long, b long").dropDuplicates(["a", "b"])
    codes = learn(vectors, size, n, params)
    shared = spark.sparkContext.broadcast(codes)
    each = codes.tables * codes.width

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                out = keys(shared.value, _matrix(part.column(1), size))
                yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), each))], names=["key", "node"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * each // 2_000_000))
    again = materialize(vectors.select("node", "embedding").mapInArrow(index, "key long, node long").repartition(parts, "key").mapInArrow(_met_again, "key long, node long"), "embedding-again")
    rows = again.join(vectors, "node").select("key", "node", "embedding")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_near(params.min_cosine - 1e-9, size), "a long, b long").dropDuplicates(["a", "b"])


def groups(table: DataFrame, params: EmbeddingParams = EmbeddingParams()) -> DataFrame:
    """(vec_id, keep_id, group_size) of every vector with an id; keep_id is the smallest id of its group."""
    ship(table.sparkSession)
    rows = table.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    # Equal vectors are one node. Its number is the smallest id; a repeated id may give two nodes one number, which joins them.
    some = rows.where("embedding is not null")
    same = materialize(some.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.collect_set("vec_id").alias("ids")), "embedding-nodes")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)
    sizes = same.where(fine).groupBy(F.size("embedding").alias("d")).count().collect()
    placed = same.select("node", F.explode("ids").alias("vec_id"))
    pairs = []
    for r in sorted(sizes, key=lambda r: r["d"]):
        if r["count"] > 1:
            vectors = materialize(same.where(fine & (F.size("embedding") == r["d"])).select("node", "embedding"), "embedding-vectors")
            pairs.append(materialize(near_pairs(vectors, r["d"], r["count"], params), "embedding-pairs"))
    if pairs:
        root = components(reduce(DataFrame.union, pairs).dropDuplicates(["a", "b"]))
        placed = placed.join(root, "node", "left").select("vec_id", F.coalesce("root", "node").alias("keep_id"))
    else:
        placed = placed.select("vec_id", F.col("node").alias("keep_id"))
    alone = rows.where("embedding is null").select("vec_id", F.col("vec_id").alias("keep_id"))
    # A repeated id belongs to the smallest of its groups; null vectors count only where the id has no other.
    placed = materialize(placed.union(alone).groupBy("vec_id").agg(F.min("keep_id").alias("keep_id")), "embedding-groups")
    return placed.join(placed.groupBy("keep_id").agg(F.count("*").alias("group_size")), "keep_id").select("vec_id", "keep_id", "group_size")
