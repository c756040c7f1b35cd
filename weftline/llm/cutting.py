"""Texts cut into words for all their characters at once, and 64-bit keys of the words, without a Python object a word."""

from __future__ import annotations

import re
from functools import cache

import numpy as np

#: Kinds of characters for runs of words and of marks.
GAP, WORD, MARK = range(3)
#: Bytes that are hashed at a time.
BLOCK = 1 << 16


def code_points() -> str:
    """Every code point in order, with ``?`` for surrogates."""
    return "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))


@cache
def word_kinds() -> np.ndarray:
    r"""By code point: \w is WORD, \s is GAP, anything else MARK."""
    out = np.full(0x110000, MARK, np.uint8)
    points = code_points()
    for kind, pattern in ((WORD, r"\w+"), (GAP, r"\s+")):
        for m in re.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


def characters(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """(where characters start in UTF-8 bytes, None if each is one byte; their first bytes; their kinds)."""
    if not len(data) or data.max() < 128:
        return None, data, kinds[data]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    low = data[at]
    code = low.astype(np.uint32)
    long = np.flatnonzero(low >= 0xC0)
    leads = low[long]
    for size, (least, most, mask) in enumerate(((0xC0, 0xE0, 0x1F), (0xE0, 0xF0, 0x0F), (0xF0, 0xF8, 0x07)), 2):
        mine = long[(leads >= least) & (leads < most)]
        value = code[mine] & np.uint32(mask)
        for k in range(1, size):
            value = (value << np.uint32(6)) | (data[at[mine] + k] & np.uint8(0x3F))
        code[mine] = value
    return at, low, kinds[code]


def runs(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one kind, all but GAP up to ``wanted``: (first byte, byte after the last, number of the text) of each."""
    at, _, kind = characters(data, kinds)
    if not len(kind):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = offsets[:-1][np.diff(offsets) > 0]
    start = np.zeros(len(kind), bool)
    start[first if at is None else np.searchsorted(at, first)] = True
    start[1:] |= kind[1:] != kind[:-1]
    places = np.flatnonzero(start)
    own = kind[places]
    places = places if at is None else at[places]
    ends = np.append(places[1:], len(data))
    fine = (own != GAP) & (own <= wanted)
    low = places[fine]
    # Runs are in order, so it is enough to find where texts begin among them.
    edges = np.concatenate([[0], np.searchsorted(low, offsets), [len(low)]])
    return low, ends[fine], np.repeat(np.arange(-1, len(offsets)), np.diff(edges))


_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(inverse: bool) -> np.ndarray:
    """Powers of the base from 0 to twice a block, or of its inverse."""
    base = np.array([pow(int(_BASE), -1 if inverse else 1, 1 << 64)], np.uint64)
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(base, 2 * BLOCK)]))


def keys(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit keys of the stretches of bytes from ``low`` to ``high``, which follow one another and aren't empty."""
    out = np.zeros(len(low), np.uint64)
    if not len(low):
        return out
    # A stretch is hashed whole: blocks end where stretches do.
    cuts = np.unique(np.append(np.searchsorted(low, np.arange(low[0], low[-1] + 1, BLOCK)), len(low))).tolist()
    for a, b in zip(cuts, cuts[1:]):
        begin = low[a]
        l, h = low[a:b] - begin, high[a:b] - begin
        powers = _powers(False)
        if h[-1] >= len(powers):  # a very long stretch
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(h[-1], _BASE)]))
        # Bytes weigh by their place in the block; dividing by the power of a stretch's start gives their place in it.
        sums = np.zeros(h[-1] + 1, np.uint64)
        np.cumsum(_BYTE[data[begin : begin + h[-1]]] * powers[1 : h[-1] + 1], out=sums[1:])
        out[a:b] = (sums[h] - sums[l]) * _powers(True)[l]
    return mix(out ^ (high - low).astype(np.uint64))
