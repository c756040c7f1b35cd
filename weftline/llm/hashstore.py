"""Sorted hash arrays in the shared folder, memory-mapped by workers.

A store is a folder with one ``.npy`` file a bucket and column. A bucket holds the keys with one value of their upper bits, sorted; the
other columns run parallel to the keys. Tasks write under names of their own and rename, and what they write depends on
the data only, so a task that is run again (a lost executor, speculation) leaves the same files.
"""

from __future__ import annotations

import math
import mmap
import os
import resource
import sys
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import give_back
from weftline.runtime import local_path, scratch, ship


def put(folder: str, name: str, array: np.ndarray) -> None:
    tmp = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(tmp, "wb") as f:
        np.save(f, array)
    os.replace(tmp, os.path.join(folder, f"{name}.npy"))


def write(df: DataFrame, name: str, bits: int) -> str:
    """Store ``df``, whose first column is the long key, in ``2 ** bits`` buckets; gives the folder.

    Value columns are numbers, or one int array (kept as offsets and a flat array). Entries that share a key can't be told
    apart, so all of them are left out and look-ups find nothing there; readers need an answer of their own for that.
    """
    spark = df.sparkSession
    ship(spark)
    folder = local_path(scratch(spark, name))
    os.makedirs(folder, exist_ok=True)
    key, *values = df.columns
    bucket = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    # Buckets fall on partitions by number, so every partition has whole buckets.
    spread = df.select(bucket.cast("int").alias("bucket"), *df.columns).repartition(1 << bits, "bucket").sortWithinPartitions("bucket")

    def save(number: int, table: pa.Table) -> int:
        k = table.column(1).combine_chunks().to_numpy().view(np.uint64) if table.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(k, kind="stable")
        k = k[order]
        same = np.concatenate([[False], k[1:] == k[:-1]])
        alone = ~(same | np.append(same[1:], False))
        k, order = k[alone], order[alone]
        for i, v in enumerate(values):
            column = table.column(2 + i).combine_chunks()
            if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
                column = column.take(pa.array(order))
                sizes = np.diff(np.asarray(column.offsets))
                put(folder, f"{v}-at-{number}", np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                put(folder, f"{v}-{number}", column.flatten().to_numpy())
            else:
                put(folder, f"{v}-{number}", column.to_numpy()[order])
        put(folder, f"{key}-{number}", k)  # last: a bucket with keys is whole
        return len(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, total = None, [], 0
        for batch in batches:
            b = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])).tolist() + [len(b)] if len(b) else []
            for low, high in zip(cuts, cuts[1:]):
                if number is not None and int(b[low]) != number:
                    total += save(number, pa.Table.from_batches(parts))
                    parts = []
                number = int(b[low])
                parts.append(batch.slice(low, high - low))
        if parts:
            total += save(number, pa.Table.from_batches(parts))
        parts = []
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    spread.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


#: Files that a process maps at once: a system allows 65530 maps by default. A map holds its file open before Python 3.13.
NO_FILE = {"trackfd": False} if sys.version_info >= (3, 13) else {}
MOST_MAPS = 40_000 if NO_FILE else min(40_000, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 2)


def mapped(path: str) -> np.ndarray:
    """The array of a file that ``put`` wrote, mapped into memory; the file doesn't stay open."""
    with open(path, "rb") as f:
        np.lib.format.read_magic(f)
        shape, by_column, kind = np.lib.format.read_array_header_1_0(f)
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **NO_FILE)
        return np.frombuffer(data, kind, math.prod(shape), f.tell()).reshape(shape, order="F" if by_column else "C")


class Store:
    """Reads a store; buckets are mapped when first asked for, and again where too many were mapped since."""

    alive: weakref.WeakSet[Store] = weakref.WeakSet()

    def __init__(self, folder: str, key: str, bits: int):
        self.folder, self.key, self.bits = folder, key, bits
        self.maps: dict[str, np.ndarray | None] = {}
        self.alive.add(self)

    def column(self, name: str, number: int) -> np.ndarray | None:
        at = f"{name}-{number}"
        if at not in self.maps:
            if sum(len(s.maps) for s in self.alive) >= MOST_MAPS:
                max(self.alive, key=lambda s: len(s.maps)).maps.clear()
            path = os.path.join(self.folder, f"{at}.npy")
            self.maps[at] = mapped(path) if os.path.exists(path) else None
        return self.maps[at]

    def buckets(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, first, after the last) of each bucket of sorted uint64 keys."""
        if not len(keys):
            return
        buckets = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])).tolist() + [len(keys)]
        for low, high in zip(starts, starts[1:]):
            yield int(buckets[low]), low, high

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For sorted uint64 keys: (bucket, numbers of the keys that it holds, their places in it)."""
        for number, low, high in self.buckets(keys):
            have = self.column(self.key, number)
            if have is None or not len(have):
                continue
            part = keys[low:high]
            place = np.searchsorted(have, part)
            place[place == len(have)] = 0
            hit = np.flatnonzero(have[place] == part)
            yield number, low + hit, place[hit]

    def values(self, name: str, number: int, at: np.ndarray) -> np.ndarray:
        return self.column(name, number)[at]


#: Counts from here on are kept apart.
MOST = 255


def put_short(folder: str, name: str, number: int, bits: int, keys: np.ndarray, counts: dict[str, np.ndarray]) -> None:
    """Save a bucket of sorted distinct keys, with counts in a byte each where they fit.

    Of a key's bits after those that the whole bucket shares, the first say in which slot it is, of about ten keys, and the
    next 32 are kept.
    """
    for column, n in counts.items():
        large = np.flatnonzero(n >= MOST)
        put(folder, f"{column}-{number}", np.minimum(n, MOST).astype(np.uint8))
        put(folder, f"{column}-large-{number}", np.stack([large, n[large]]).astype(np.int64))
    size = slot_bits(len(keys))
    slot, rest = slots(keys, bits, size)
    put(folder, f"{name}-slots-{number}", np.searchsorted(slot, np.arange((1 << size) + 1)).astype(np.uint32))
    put(folder, f"{name}-{number}", rest)  # last: a bucket with keys is whole


def slot_bits(n: int) -> int:
    return max(0, n.bit_length() - 4)


def slots(keys: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of keys, the 32 bits after those)."""
    tail = keys << np.uint64(bits)
    slot = (tail >> np.uint64(64 - size)).astype(np.int64) if size else np.zeros(len(keys), np.int64)
    return slot, ((tail << np.uint64(size)) >> np.uint64(32)).astype(np.uint32)


class ShortStore(Store):
    """Reads what ``put_short`` wrote."""

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for number, first, stop in self.buckets(keys):
            have, table = self.column(self.key, number), self.column(f"{self.key}-slots", number)
            if have is None or not len(have):
                continue
            slot, part = slots(keys[first:stop], self.bits, slot_bits(len(have)))
            low, end = table[slot].astype(np.int64), table[slot + 1].astype(np.int64)
            high = end
            while (some := low < high).any():
                middle = (low + high) >> 1
                less = have[np.minimum(middle, len(have) - 1)] < part
                low, high = np.where(some & less, middle + 1, low), np.where(some & ~less, middle, high)
            inside = np.flatnonzero(low < end)
            hit = inside[have[low[inside]] == part[inside]]
            yield number, first + hit, low[hit]

    def values(self, name: str, number: int, at: np.ndarray) -> np.ndarray:
        out = self.column(name, number)[at].astype(np.int64)
        if len(large := np.flatnonzero(out == MOST)):
            places, counts = self.column(f"{name}-large", number)
            out[large] = counts[np.searchsorted(places, at[large])]
        return out
