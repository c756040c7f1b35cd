"""Operator 8: byte-level BPE encoding and decoding.

Texts are cut into words as the vocabulary's pattern says, for all characters of a slice of texts at once (``word_starts``).
The distinct words of all texts are encoded once: a Spark array fold starts from a word's single bytes and merges, again
and again, the leftmost pair of lowest rank, looked up in a literal rank map (an array of small maps, as a Spark map is
searched entry by entry). Pieces are written in hexadecimal, two digits a byte, inside the fold. The encoded words go to
sorted hash arrays in the shared folder; each text's words are then looked up there by the workers, so neither texts nor
tokens are shuffled. Decoding joins the pieces' bytes.

Defined results:
- a null text has null ids, no tokens (0) and a null decoding; an empty text has an empty array and decodes to itself;
- words of any length, and so very long texts, are merged in full; the fold's work grows with the square of a word's length,
  so those of more than ``LONGEST`` bytes are merged by the worker that meets them, with a heap;
- rows with a null id, repeated rows and ties each give a row; an empty table gives no rows; other columns are ignored;
- decoding: an id outside the vocabulary, or a null id, adds nothing; bytes that are not UTF-8 become U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import cutting, hashstore
from weftline.llm.batches import give_back, map_rows, remembered, text_slices, utf8_bytes
from weftline.runtime import materialize, ship

#: The word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 65_536
NONE = 2**31 - 1
LONGEST = 256
#: Keys of words that a task remembers as seen; beyond it they are forgotten, which costs time only.
SEEN = 1_500_000

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


@dataclass(frozen=True)
class BpeParams:
    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    #: The encoded words are kept in 2 ** bits buckets; None: from their number.
    bits: int | None = None


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, seed=42)


@cache
def _rank_json(path: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in load_ranks(path).items():
        h = piece.hex().upper()
        signed = _hash(h.encode())
        buckets[signed % BUCKETS][h] = rank
    return json.dumps(buckets, separators=(",", ":"))


def rank_table(path: str) -> Column:
    """The rank map, folded into one literal when the plan is optimised."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def rank_in(table: Column):
    """The rank of a piece in hexadecimal, as an expression; NONE for what is no piece."""

    def look(piece: Column) -> Column:
        # BUCKETS is a power of two, so the low bits of the signed hash are the unsigned remainder.
        slot = F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
        return F.coalesce(F.try_element_at(F.get(table, slot), piece), F.lit(NONE))

    return look


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, path: str) -> Column:
    """Token ids of one word, as an expression; the rank map is in it once, bound to a lambda variable."""
    return _let(rank_table(path), lambda table: _fold(word, rank_in(table)))


def _fold(word: Column, rank) -> Column:
    digits = F.hex(F.encode(word, "UTF-8"))
    size = (F.length(digits) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(digits, i * 2 - 1, F.lit(2)))

    def start(p: Column) -> Column:
        # The rank beside a piece is that of its merger with the next; the last piece has none.
        ranks = F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, rank(F.concat(x, F.get(p, i + 1)))).otherwise(F.lit(NONE)))
        return F.struct(p.alias("p"), ranks.alias("r"))

    def step(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def merge(i: Column) -> Column:
            # i: place, from 1, of the leftmost pair of lowest rank.
            n = F.size(p)

            def put(piece: Column) -> Column:
                # Two passes with an index are cheaper than slices, which copy element by element through a sequence.
                here = F.when(i + 1 < n, rank(F.concat(piece, F.get(p, i + 1)))).otherwise(F.lit(NONE))
                before = rank(F.concat(F.get(p, i - 2), piece))
                merged = F.transform(p, lambda x, k: F.when(k == i - 1, piece).otherwise(x))
                ranks = F.transform(r, lambda x, k: F.when(k == i - 1, here).when(k == i - 2, before).otherwise(x))
                return F.struct(F.filter(merged, lambda x, k: k != i).alias("p"), F.filter(ranks, lambda x, k: k != i).alias("r"))

            return _let(F.concat(F.get(p, i - 1), F.get(p, i)), put)

        return _let(F.array_min(r), lambda m: F.when(m == NONE, state).otherwise(_let(F.array_position(r, m).cast("int"), merge)))

    done = F.aggregate(F.sequence(F.lit(1), size), _let(pieces, start), step)
    return F.transform(done["p"], lambda x: rank(x))


def merge_ranks(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in Python, by a heap over linked pieces, in time n log n.

    For very long words, for two words with one key, and for tests.
    """
    n = len(word)
    end = list(range(1, n + 1))  # the piece that starts at i ends here; 0: merged into the one before it
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# -- words

OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def _kinds() -> np.ndarray:
    """What the pattern takes every code point for."""
    out = np.zeros(0x110000, np.uint8)
    points = cutting.code_points()
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


def word_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words start in the UTF-8 bytes of texts laid end to end; ``first``: where the texts that aren't empty start.

    The pattern's own cuts, found for all characters at once: a run of one kind is a word; it takes in a space before it;
    of longer white space before a word, all but its last character is a word; short endings after an apostrophe are words.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    at, low, kind = cutting.characters(data, _kinds())
    n = len(kind)
    fresh = np.zeros(n, bool)
    fresh[first if at is None else np.searchsorted(at, first)] = True
    white = kind == SPACE
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    joined = np.zeros(n, bool)
    joined[1:] = (low[:-1] == 32) & ~fresh[1:] & ~white[1:]
    start &= ~joined
    start[:-1] |= white[:-1] & ~white[1:] & ~fresh[1:]
    marks = np.flatnonzero(start & (low == 39))
    if len(marks):

        def after(k: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.minimum(marks + k, n - 1)
            same = before & (marks + k < n) & ~fresh[place]
            return np.where(same, low[place], 0), same

        one, same = after(1, np.ones(len(marks), bool))
        two, _ = after(2, same)
        short = np.isin(one, list(b"stmd"))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for which, size in ((short, 2), (long, 3)):
            start[marks[which] + 1] = False
            end = marks[which] + size
            start[end[end < n]] = True
    places = np.flatnonzero(start)
    return places if at is None else at[places]


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice of texts one after another, and how many each text has."""
    data, offsets = utf8_bytes(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    places = word_starts(data, offsets[:-1][np.diff(offsets) > 0])
    ends = np.append(places, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return words, np.diff(np.searchsorted(places, offsets))


def word_keys(words: pa.Array) -> np.ndarray:
    data, offsets = utf8_bytes(words)
    return cutting.keys(data, offsets[:-1], offsets[1:])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word) of the distinct words of a task, some of them again and again if there are very many."""
    remembered("bpe-words", lambda: None)
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        for part in text_slices(batch, "text"):
            words = cut_words(part.column(0))[0].dictionary_encode().dictionary
            keys = word_keys(words)
            at = np.searchsorted(seen, keys)
            fresh = seen[np.minimum(at, len(seen) - 1)] != keys if len(seen) else np.ones(len(keys), bool)
            new = np.sort(keys[fresh])
            seen = np.insert(seen, np.searchsorted(seen, new), new) if len(seen) + len(new) < SEEN else np.sort(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), words.filter(pa.array(fresh))], names=["key", "word"])
    give_back()


def distinct_words(docs: DataFrame) -> DataFrame:
    """(key, word) of the distinct words of all texts."""
    ship(docs.sparkSession)
    return docs.select("text").where(F.col("text").isNotNull()).mapInArrow(_word_rows, "key long, word string").distinct()


def encoded_words(docs: DataFrame, params: BpeParams) -> DataFrame:
    """(key, ids) of the distinct words of all texts."""
    words = distinct_words(docs)
    return words.where(F.octet_length("word") <= LONGEST).select("key", fold(F.col("word"), params.ranks).alias("ids"))


class Encoder:
    def __init__(self, folder: str, bits: int, ranks: str):
        self.store, self.ranks = hashstore.Store(folder, "key", bits), ranks

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, how many it has)."""
        keys = word_keys(words)
        order = np.argsort(keys)
        begin, size, total, parts = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64), 0, []
        for number, which, place in self.store.find(keys[order]):
            at, ids = self.store.column("ids-at", number), self.store.column("ids", number)
            low = at[place]
            n = at[place + 1] - low
            parts.append(ids[_ranges(low, n)])
            mine = order[which]
            begin[mine], size[mine] = total + np.cumsum(n) - n, n
            total += int(n.sum())
        for i in np.flatnonzero(size < 0).tolist():
            ids = np.array(merge_ranks(words[i].as_py().encode(), load_ranks(self.ranks)), np.int32)
            parts.append(ids)
            begin[i], size[i] = total, len(ids)
            total += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), begin, size

    def texts(self, texts: pa.Array) -> pa.Array:
        """The ids of each text."""
        words, counts = cut_words(texts)
        coded = words.dictionary_encode()
        flat, begin, size = self._ids(coded.dictionary)
        which = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[which])])
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        missing = texts.is_null().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), pa.array(flat[_ranges(begin[which], size[which])]))


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ..., n of them, for one after another."""
    ends = np.cumsum(n)
    return np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def encode(docs: DataFrame, params: BpeParams = BpeParams()) -> DataFrame:
    """(doc_id, text, ids) of every row of ``docs``."""
    words = materialize(encoded_words(docs, params), "bpe-words")
    bits = params.bits if params.bits is not None else max(0, int(np.ceil(np.log2(max(1, words.count() / 200_000)))))
    folder = hashstore.write(words, "bpe-store", bits)
    ranks = params.ranks

    def make():
        encoder = remembered(("bpe", folder), lambda: Encoder(folder, bits, ranks))
        return lambda part: [part.column(0).cast(pa.int64()), part.column(1), encoder.texts(part.column(1))]

    return map_rows(docs, ["doc_id", "text"], SCHEMA, make)


@cache
def _piece_json(path: str) -> str:
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    return json.dumps(pieces, separators=(",", ":"))


def decode(ids: Column, params: BpeParams = BpeParams()) -> Column:
    """The text of an array of ids, as an expression over one literal array of pieces."""
    table = F.from_json(F.lit(_piece_json(params.ranks)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")).cast("string")


def tokens(docs: DataFrame, params: BpeParams = BpeParams()) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): encoding of every row, and whether decoding gives its text again."""
    done = encode(docs, params)
    return done.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids", (decode(F.col("ids"), params) == F.col("text")).alias("round_trip"))
