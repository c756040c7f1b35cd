"""Operator 1: near-duplicate documents by SimHash with signature variants.

A document's signature has ``BITS`` bits: each is the sign of a sum over its distinct words, weighted by the root of
their counts. Two documents are near copies when their signatures differ in at most ``max_distance`` bits. A signature is
cut into so many segments that two signatures within ``max_distance`` always have a segment that differs by at most
``RADIUS`` bits: 11 for 32 bits. For each segment the signatures are kept sorted by it, in buckets by its upper bits; every
variant of a segment with up to ``RADIUS`` changed bits is looked up there, and the whole signatures are verified. Every
pair within ``max_distance`` meets, whatever bits it differs in.

Groups are the connected components over verified pairs; ``keep_id`` is the smallest id of the group.

Work is kept in proportion: equal signatures are one node from the start; an index row is a node with its signature, once
a segment; a segment's pair is looked at once; between two buckets, a spanning forest of the verified pairs is kept instead
of all pairs, which leaves the components the same. Nothing is capped. Workers map the buckets into memory, so the shared
folder must be a mounted one.

Defined results:
- null, empty and wordless texts have no signature: each such document is its own group;
- a null id can't be grouped: such rows give no row of ``groups``, and ``deduplicate`` keeps them;
- repeated ids count as one document; ``deduplicate`` keeps one row of a repeated id with the same text;
- an empty table gives no rows; other columns are ignored (``groups``) or passed through unchanged (``deduplicate``).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import cutting, hashstore
from weftline.llm.batches import give_back, map_rows, remembered, utf8_bytes
from weftline.runtime import BROADCAST_LIMIT_BYTES, discard, local_path, materialize, scratch, ship, shuffles_removed

BITS = 256
LANES = BITS // 64
#: Segments of ``deletion_keys``, which guarantee pairs up to 15 bits; ``near_pairs`` cuts signatures by ``cuts``.
SEGMENTS = 8
WIDTH = BITS // SEGMENTS
#: Bits by which a segment's variants differ from it.
RADIUS = 2
#: Signatures of a bucket, and pairs verified at once.
BUCKET_ROWS, BLOCK = 1 << 14, 1 << 18

SIGNATURE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words", T.IntegerType()), *[T.StructField(f"s{i}", T.LongType()) for i in range(LANES)]])
LANE_NAMES = [f"s{i}" for i in range(LANES)]
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


@dataclass(frozen=True)
class SimHashParams:
    max_distance: int = 32


# -- signatures


def signatures_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, signatures as (texts, LANES) int64)."""
    data, offsets = utf8_bytes(pc.utf8_lower(texts.fill_null("")))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    low, high, owner = cutting.runs(data, offsets, cutting.word_kinds(), cutting.WORD)
    sizes = np.bincount(owner, minlength=len(texts)).astype(np.int32)
    words, number = np.unique(cutting.keys(data, low, high), return_inverse=True)
    # Each text's distinct words with their counts, text after text.
    pairs, counts = np.unique(owner * len(words) + number, return_counts=True)
    # Whole multiples of 1/64, so that a sum doesn't depend on the words' order.
    weights = np.floor(np.sqrt(counts) * 64 + 0.5).astype(np.float32) / np.float32(64)
    number = pairs % max(1, len(words))
    edges = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(words))
    # A word's bit pattern: four mixed copies of its key.
    lanes = np.stack([cutting.mix(words + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64)) for k in range(LANES)], axis=1)
    patterns = np.unpackbits(lanes.astype(">u8").view(np.uint8).reshape(len(words), BITS // 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)
    sums = np.zeros((len(texts), BITS), np.float32)
    for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
        for k in range(a, b, 8192):
            stop = min(b, k + 8192)
            sums[i] += weights[k:stop] @ patterns[number[k:stop]].astype(np.float32)
    packed = np.packbits(sums > 0, axis=1)
    return sizes, packed.view(">i8").astype(np.int64).reshape(len(texts), LANES)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, words, s0..s3) of every row; no shuffle."""

    def make():
        remembered("simhash", lambda: None)

        def kernel(part: pa.RecordBatch) -> list:
            sizes, lanes = signatures_of(part.column(1))
            return [part.column(0).cast(pa.int64()), pa.array(sizes), *[pa.array(lanes[:, i]) for i in range(LANES)]]

        return kernel

    return map_rows(docs, ["doc_id", "text"], SIGNATURE, make)


# -- index


def deletion_keys(lanes: np.ndarray) -> np.ndarray:
    """(signatures, BITS) uint64 keys: each bit of a signature deleted from its segment, marked with the bit's number."""
    u = lanes.astype(np.int64).view(np.uint64).reshape(len(lanes), LANES)
    per_lane = 64 // WIDTH
    out = np.empty((len(u), BITS), np.uint64)
    mask = np.uint64((1 << WIDTH) - 1)
    for lane in range(LANES):
        for part in range(per_lane):
            segment = (u[:, lane] >> np.uint64(64 - WIDTH * (part + 1))) & mask
            base = lane * 64 + part * WIDTH
            for bit in range(WIDTH):
                low = segment & np.uint64((1 << bit) - 1)
                high = (segment >> np.uint64(bit + 1)) << np.uint64(bit)
                out[:, base + bit] = (np.uint64(base + bit) << np.uint64(WIDTH)) | high | low
    return out


def distances(lanes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bits in which rows of ``lanes`` and ``other`` differ."""
    return np.bitwise_count(lanes.view(np.uint64) ^ other.view(np.uint64)).sum(axis=-1, dtype=np.int64)


@dataclass(frozen=True)
class Index:
    """How signatures are cut into keys, one of each segment, and keys into buckets by their ``upper`` bits."""

    starts: list[int]  # first bits of the segments
    width: int  # bits of a key
    upper: int
    folder: str = ""

    @property
    def lower(self) -> int:
        return self.width - self.upper

    def keys(self, lanes: np.ndarray, segment: int) -> np.ndarray:
        """The segment's keys of (signatures, LANES) lanes."""
        u = lanes.view(np.uint64)
        lane, at = divmod(self.starts[segment], 64)
        key = u[:, lane] << np.uint64(at)
        if at + self.width > 64:
            key |= u[:, lane + 1] >> np.uint64(64 - at)
        return (key >> np.uint64(64 - self.width)).astype(np.int64)

    def path(self, segment: int, bucket: int) -> str:
        return os.path.join(self.folder, f"rows-{segment}-{bucket}.npy")


def cuts(n: int, max_distance: int) -> Index:
    """The index for ``n`` signatures. If every segment differed by more than RADIUS bits, the signatures would by more than ``max_distance``."""
    segments = max_distance // (RADIUS + 1) + 1
    if segments > BITS:
        raise ValueError(f"max_distance must be less than {BITS * (RADIUS + 1)}")
    starts = [BITS * i // segments for i in range(segments)]
    # A part of a segment differs by no more bits than the segment does; few signatures need only short keys.
    width = min(BITS // segments, 24, n.bit_length() + 6)
    return Index(starts, width, min(width - 1, max(0, (-(-n // BUCKET_ROWS) - 1).bit_length())))


def _index_rows(index: Index):
    """Each signature once a segment, with its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = np.stack([batch.column(1 + i).to_numpy() for i in range(LANES)], axis=1)
            for segment in range(len(index.starts)):
                bucket = (segment << index.upper) + (index.keys(lanes, segment) >> index.lower)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], names=["bucket", "node", *LANE_NAMES])
        give_back()

    return run


def _save_buckets(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write the buckets of this partition, each sorted by its segment's keys; a bucket's rows are all in one partition."""
        parts = [np.stack([column.to_numpy() for column in batch.columns], axis=1) for batch in batches]
        if not parts:
            return
        rows = np.concatenate(parts)
        del parts
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        edges = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]])).tolist()
        for low, high in zip(edges, edges[1:]):
            segment, bucket = divmod(int(rows[low, 0]), 1 << index.upper)
            part = rows[low:high, 1:]
            order = np.lexsort((*part.T, index.keys(part[:, 1:], segment)))
            hashstore.put(index.folder, f"rows-{segment}-{bucket}", part[order])
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])
        del rows, part
        give_back()

    return run


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of this partition whose key occurs more than once in it; a key's rows are all in one partition."""
    keys, nodes = [], []
    for batch in batches:
        keys.append(batch.column(0).to_numpy())
        nodes.append(batch.column(1).to_numpy())
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(nodes)
    del keys, nodes
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    key, node = key[again], node[again]
    for k in range(0, len(key), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(key[k : k + (1 << 16)]), pa.array(node[k : k + (1 << 16)])], names=["key", "node"])
    give_back()


class _Forest:
    """A spanning forest of pairs of ``n`` rows, grown by blocks of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def added(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs that join two trees."""
        out = [(a[:0], b[:0])]
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return tuple(np.concatenate(c) for c in zip(*out))
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            self.root[high[first]] = low[first]
            out.append((a[first], b[first]))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up


def _candidates(mine: np.ndarray, starts: np.ndarray, bits: int, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, in blocks, whose keys of ``bits`` bits differ in at most ``radius`` of them.

    ``mine``: the sorted keys of one bucket; ``starts``: where each key's rows start in the other one; ``same``: both are one.
    """
    rows = np.arange(len(mine))
    for size in range(min(radius, bits) + 1):
        for changed in combinations(range(bits), size):
            other = mine ^ sum(1 << bit for bit in changed)
            low, high = starts[other], starts[other + 1]
            if same:
                low = np.maximum(low, rows + 1)
            some = np.flatnonzero(high > low)
            if not len(some):
                continue
            low, count = low[some], (high[some] - low[some])
            ends = np.cumsum(count)
            done = 0
            while done < len(some):
                before = int(ends[done - 1]) if done else 0
                stop = max(done + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
                n = count[done:stop]
                shift = low[done:stop] - (ends[done:stop] - n - before)
                yield np.repeat(some[done:stop], n), np.arange(int(ends[stop - 1]) - before) + np.repeat(shift, n)
                done = stop


def _near_rows(index: Index, limit: int):
    def load(segment: int, bucket: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray] | None:
        """(nodes, lanes with those of the segment last, lower bits of the keys) of a bucket."""
        if not os.path.exists(at := index.path(segment, bucket)):
            return None
        rows = np.load(at, mmap_mode="r")
        first = index.starts[segment] // 64 + 2
        lanes = [np.ascontiguousarray(rows[:, 1 + (first + i) % LANES]).view(np.uint64) for i in range(LANES)]
        return rows[:, 0], lanes, index.keys(rows[:, 1:], segment) & ((1 << index.lower) - 1)

    def verified(a: np.ndarray, b: np.ndarray, mine: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows within ``limit``; half of the lanes tells most of them apart."""
        half = LANES // 2
        apart = sum(np.bitwise_count(x[a] ^ y[b]) for x, y in zip(mine[:half], others[:half]))
        near = np.flatnonzero(apart <= limit)
        a, b, apart = a[near], b[near], apart[near].astype(np.int64)
        near = apart + sum(np.bitwise_count(x[a] ^ y[b]).astype(np.int64) for x, y in zip(mine[half:], others[half:])) <= limit
        return a[near], b[near]

    def between(one: tuple, other: tuple, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (node, lanes, keys), (nodes, others, their) = one, other
        shift = 0 if same else len(node)
        forest = _Forest(shift + len(nodes))
        starts = np.concatenate([[0], np.cumsum(np.bincount(their, minlength=1 << index.lower))])
        for a, b in _candidates(keys, starts, index.lower, radius, same):
            a, b = verified(a, b, lanes, others)
            if len(a):
                a, b = forest.added(a, b + shift)
                yield node[a], nodes[b - shift]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (segment and bucket): the near pairs of each bucket with itself and with later ones that few upper bits tell from it."""
        remembered("simhash-near", lambda: None)
        for batch in batches:
            for item in batch.column(0).to_pylist():
                segment, bucket = divmod(item, 1 << index.upper)
                if (one := load(segment, bucket)) is None:
                    continue
                for size in range(min(RADIUS, index.upper) + 1):
                    for changed in combinations(range(index.upper), size):
                        number = bucket ^ sum(1 << bit for bit in changed)
                        if number < bucket or (other := one if number == bucket else load(segment, number)) is None:
                            continue
                        for a, b in between(one, other, RADIUS - size, number == bucket):
                            two = a != b  # a repeated id can have several signatures
                            if two.any():
                                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[two]), pa.array(np.maximum(a, b)[two])], names=["a", "b"])
        give_back()

    return run


def near_pairs(nodes: DataFrame, params: SimHashParams) -> DataFrame:
    """(a, b), a < b: pairs within ``max_distance`` that join all that such pairs join. ``nodes``: (node, s0..s3), one row a signature."""
    spark = nodes.sparkSession
    ship(spark)
    signed = nodes.select("node", *LANE_NAMES)
    n = signed.count()
    at = scratch(spark, "simhash-index")
    index = replace(cuts(n, params.max_distance), folder=local_path(at))
    os.makedirs(index.folder, exist_ok=True)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = len(index.starts) << index.upper
    schema = "bucket long, node long, " + ", ".join(f"{lane} long" for lane in LANE_NAMES)
    # A partition's rows, of 48 bytes, are sorted in memory by the Python worker.
    spread = signed.mapInArrow(_index_rows(index), schema).repartition(max(partitions, -(-n * len(index.starts) // 500_000)), "bucket")
    with shuffles_removed(spark):
        spread.mapInArrow(_save_buckets(index), "n long").write.format("noop").mode("overwrite").save()
    work = spark.range(0, items, 1, min(items, max(partitions, items // 8))).mapInArrow(_near_rows(index, params.max_distance), EDGE)
    with shuffles_removed(spark):
        found = materialize(work.dropDuplicates(["a", "b"]), "simhash-pairs")
    discard(spark, at)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for every node that has an edge.

    Alternating large-star and small-star steps, each written to the shared folder, the one before removed; the number of
    rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, before: str | None) -> tuple[DataFrame, str]:
        at = scratch(spark, "simhash-edges")
        df.write.parquet(at)
        if before:
            discard(spark, before)
        return spark.read.schema(df.schema).parquet(at), at

    edges, at = written(edges, None)
    while True:
        # Large star: link every larger neighbour of a node to the smallest node around it.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # Small star: link a node and its smaller neighbours to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("top"), F.least("a", "b").alias("to"))
        least = down.groupBy("top").agg(F.min("to").alias("low"))
        linked = down.join(least, "top")
        small = (
            linked.select(F.col("low").alias("a"), F.col("to").alias("b"))
            .union(linked.select(F.col("low").alias("a"), F.col("top").alias("b")))
            .where("a <> b")
            .distinct()
        )
        small, at = written(small, at)
        # Done when every node hangs on one root that itself hangs on nothing.
        unfinished = small.groupBy("b").count().where("count > 1").limit(1).count() or small.join(small.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        edges = small
        if not unfinished:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def groups(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, keep_id, group_size) of every document with an id; keep_id is the smallest id of its group."""
    ship(docs.sparkSession)
    signed = materialize(signatures(docs.where(F.col("doc_id").isNotNull())), "simhash-signatures")
    # A document whose id is repeated with several texts takes part with each of its signatures.
    own = signed.where("words > 0").groupBy(*LANE_NAMES).agg(F.min("doc_id").alias("node"))
    # Signatures with the same smallest id (repeated ids) get separate rows; the node is that id for all of them.
    nodes = materialize(own, "simhash-nodes")
    root = components(near_pairs(nodes, params))
    member = signed.where("words > 0").select("doc_id", *LANE_NAMES).distinct().join(nodes, LANE_NAMES).select("doc_id", "node")
    placed = member.join(root, "node", "left").select("doc_id", F.coalesce("root", "node").alias("keep_id")).groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"))
    placed = placed.union(signed.where("words = 0").select("doc_id", F.col("doc_id").alias("keep_id")).distinct().join(placed.select("doc_id"), "doc_id", "left_anti"))
    placed = materialize(placed, "simhash-groups")
    sizes = placed.groupBy("keep_id").agg(F.count("*").alias("group_size"))
    return placed.join(sizes, "keep_id").select("doc_id", "keep_id", "group_size")


def deduplicate(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, all columns unchanged."""
    placed = groups(docs, params)
    gone = materialize(placed.where("doc_id <> keep_id").select("doc_id"), "simhash-gone")
    # Ids to drop are sent to every executor only while they are few; beyond that both sides are shuffled by id.
    side = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_LIMIT_BYTES else gone
    kept = docs.join(side, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialize(again, "simhash-repeated")
    if not (n := again.count()):
        return kept
    again = F.broadcast(again) if n * 16 <= BROADCAST_LIMIT_BYTES else again
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
