"""Stores of many buckets in one process."""

import os
import resource
import sys

import numpy as np

from weftline.llm import hashstore

BITS = 9


def stored(folder):
    """A short store of 512 buckets; gives its keys, sorted, and their counts."""
    keys = np.unique(np.random.default_rng(6).integers(0, 2**64, 20_000, np.uint64))
    counts = np.arange(len(keys)) % 300
    for bucket, low, high in hashstore.Store("", "", BITS).buckets(keys):
        hashstore.put_short(str(folder), "key", bucket, BITS, keys[low:high], {"n": counts[low:high]})
    return keys, counts


def read(store, keys):
    out = np.full(len(keys), -1)
    for bucket, which, at in store.find(keys):
        out[which] = store.values("n", bucket, at)
    return out


def test_buckets_are_mapped_without_open_files_and_within_a_bound(tmp_path, monkeypatch):
    keys, counts = stored(tmp_path)
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    # Far fewer open files than the four of each bucket.
    if sys.version_info < (3, 13):
        monkeypatch.setattr(hashstore, "MOST_MAPS", 100)
    try:
        resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 200, before[1]))
        assert (read(hashstore.ShortStore(str(tmp_path), "key", BITS), keys) == counts).all()
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)
    monkeypatch.setattr(hashstore, "MOST_MAPS", 50)
    one, other = (hashstore.ShortStore(str(tmp_path), "key", BITS) for _ in range(2))
    for store in (one, other, one):
        assert (read(store, keys) == counts).all() and len(one.maps) + len(other.maps) <= 50
