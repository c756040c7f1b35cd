"""Operator 6: perplexity under an interpolated modified Kneser-Ney model.

Tokens are words and runs of marks, in lower case; a document is read from ``order - 1`` start marks to an end mark. All
words are numbered first, so that runs of words travel as packed numbers, a row for each bucket of a task. The runs of
``order`` words are counted over all documents: a task sums its own first, then each bucket of them is summed by one task,
which writes its sorted hash array to the shared folder. Each lower level counts the distinct words before a
run, so a bucket's distinct runs go on without their first word to the buckets of the next level, down to pairs; those
give for each word how often it is followed, by how many words once, twice or more often, and how many words it follows.
The three discounts of each level follow from its counts of counts. A run's probability is its discounted share plus the
context's left-over mass times the probability of the run without its first word; the last level is interpolated with
the uniform one. Workers map the arrays into memory and score every document whole.

The registered query has order 3 (``PRODUCTION``).

Words are known by 64-bit hashes, pairs by 64-bit keys whose upper part comes from the first word, and from ``SPREAD``
values of the second so that a frequent word is spread over several buckets. Two pairs with one key would be counted
together: at ten billion pairs a few are expected. Arrays keep a key's bucket, its slot there and 32 bits more, 49 bits of
it inside a bucket of 1.3 million runs: two of a bucket's runs share these in two of a thousand such buckets.

Defined results:
- a null text has 0 tokens and null log_prob and perplexity, and isn't counted; an empty one is scored as its end mark;
- rows with a null id are counted and scored like any other; repeated rows count each time; texts of any length are
  scored whole; an empty table gives no rows; other columns are ignored;
- discounts that the counts of counts can't give (too few pairs) are 0.5, 1 and 1.5.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import cutting, hashstore
from weftline.llm.batches import give_back, map_rows, remembered, text_slices, utf8_bytes
from weftline.llm.cutting import mix
from weftline.runtime import discard, local_path, materialize, scratch, ship, shuffles_removed

#: What a token is; cutting.runs finds the same.
TOKEN = re.compile(r"\w+|[^\w\s]+")
START, END = np.uint64(1), np.uint64(2)
SPREAD = np.uint64(7)
#: Runs of words that a counting task holds before it hands them on.
HELD = 1_500_000
#: Text bytes that are scored at once: every slice looks into every bucket.
SCORED_BYTES = 8 << 20

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])
STATS = "w long, followed long, n1 long, n2 long, n3 long, follows long, c1 long, c2 long, c3 long, c4 long"


@dataclass(frozen=True)
class LmParams:
    order: int = 2
    #: Text bytes for each bucket of pairs.
    bucket_bytes: int = 16 << 20
    max_bits: int = 16


PRODUCTION = LmParams(order=3)


@dataclass
class Model:
    grams: list[str]  # folders of pairs, triples, ...
    bits: int
    words: str
    word_bits: int
    discounts: list[np.ndarray]  # of pairs, triples, ..., by min(count, 3); [0] is 0
    unseen: float  # probability of a word that was never counted


def read(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(first, ..., last words of all runs of ``order`` words), with (texts,) numbers of runs; a null text has none."""
    data, offsets = utf8_bytes(pc.utf8_lower(texts.fill_null("")))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    low, high, owner = cutting.runs(data, offsets, cutting.word_kinds(), cutting.MARK)
    words = cutting.keys(data, low, high)
    words[words < 3] += np.uint64(3)
    sizes = np.bincount(owner, minlength=len(texts)) + texts.is_valid().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    last = np.full(total, END, np.uint64)
    inner = np.ones(total, bool)
    inner[ends[sizes > 0] - 1] = False
    last[inner] = words
    place = np.arange(total) - np.repeat(ends - sizes, sizes)
    grams = [last]
    for back in range(1, order):
        before = np.full(total, START, np.uint64)
        before[back:] = np.where(place[back:] >= back, last[: max(0, total - back)], START)
        grams.insert(0, before)
    return grams, sizes


def _place(sizes: np.ndarray) -> np.ndarray:
    """The place of each run in its text."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _before(number: np.ndarray, start: int, place: np.ndarray, back: int) -> np.ndarray:
    """Numbers of the words ``back`` before those of ``number``, with ``start`` for start marks."""
    out = np.full(len(number), start)
    out[back:] = np.where(place[back:] >= back, number[: max(0, len(number) - back)], start)
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct sorted values; ``np.unique`` puts them in a hash table, which takes many times as long as a sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    upper = mix(first + (second & SPREAD) * np.uint64(0x9E3779B97F4A7C15))
    lower = mix(first * np.uint64(0xD6E8FEB86659FD93) ^ mix(second))
    return (upper & np.uint64(0xFFFF000000000000)) | (lower >> np.uint64(16))


def context_keys(words: list[np.ndarray]) -> np.ndarray:
    """Keys of contexts of two words or more."""
    h = words[0]
    for k, w in enumerate(words[1:], 2):
        h = mix((h + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) ^ mix(w))
    return h


def gram_keys(words: list[np.ndarray]) -> np.ndarray:
    """Keys of runs of words; from three words on, the upper part is that of the context's key, so that a context's runs share a bucket."""
    if len(words) == 2:
        return pair_keys(*words)
    context = context_keys(words[:-1])
    lower = mix(context * np.uint64(0x9E3779B97F4A7C15) ^ mix(words[-1]))
    return (context & np.uint64(0xFFFF000000000000)) | (lower >> np.uint64(16))


#: Runs of words of a bucket: the numbers of its distinct words, which of them each run has and how often it occurs, compressed.
PACKED = "bucket int, words int, runs int, data binary"


@dataclass
class Vocabulary:
    """All words' hashes, in order; a word's number is its place."""

    folder: str
    bits: int
    starts: np.ndarray  # number of the first word of each bucket, and of all words

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of sorted words."""
        store, out = hashstore.Store(self.folder, "key", self.bits), np.zeros(len(words), np.int64)
        for bucket, which, at in store.find(words):
            out[which] = self.starts[bucket] + at
        return out

    def words(self, numbers: np.ndarray) -> np.ndarray:
        """Words of sorted numbers."""
        store, out = hashstore.Store(self.folder, "key", self.bits), np.zeros(len(numbers), np.uint64)
        edges = np.searchsorted(numbers, self.starts)
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            low, high = edges[bucket], edges[bucket + 1]
            out[low:high] = store.column("key", bucket)[numbers[low:high] - self.starts[bucket]]
        return out


def _word_rows(bits: int):
    """A task's distinct words, one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("lm-count", lambda: None)
        known = np.array([START, END])
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            words = _distinct(np.concatenate([known, *held]))
            held.clear()
            for bucket, low, high in hashstore.Store("", "", bits).buckets(words):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([words[low:high].tobytes()], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for part in text_slices(batch, "text"):
                held.append(_distinct(read(part.column(0), 1)[0][0]))
                size += len(held[-1])
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()
        give_back()

    return run


def _vocabulary_rows(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, data in zip(*(column.to_pylist() for column in batch.columns)):
                parts.setdefault(bucket, []).append(np.frombuffer(data, np.uint64))
        for bucket, words in parts.items():
            words = _distinct(np.concatenate(words))
            hashstore.put(folder, f"key-{bucket}", words)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(words)], pa.int64())], names=["bucket", "n"])
        give_back()

    return run


def vocabulary_of(texts: DataFrame, bits: int) -> Vocabulary:
    spark = texts.sparkSession
    folder = local_path(scratch(spark, "lm-vocabulary"))
    os.makedirs(folder, exist_ok=True)
    rows = texts.mapInArrow(_word_rows(bits), "bucket int, data binary").repartitionById(1 << bits, F.col("bucket"))
    with shuffles_removed(spark):
        sizes = materialize(rows.mapInArrow(_vocabulary_rows(folder), "bucket int, n long"), "lm-sizes").collect()
    count = np.zeros(1 << bits, np.int64)
    for r in sizes:
        count[r["bucket"]] = r["n"]
    return Vocabulary(folder, bits, np.concatenate([[0], np.cumsum(count)]))


def _planes(x: np.ndarray, most: int) -> bytes:
    """Whole numbers up to ``most``, their first bytes before their second ones and so on."""
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    return np.dtype(kind).str.encode().ljust(4) + np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    kind = np.dtype(bytes(data[:4]).decode().strip())
    stop = 4 + n * kind.itemsize
    planes = np.frombuffer(data[4:stop], np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n), data[stop:]


def _packed_rows(key: np.ndarray, numbers: np.ndarray, runs: list[np.ndarray], n: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """``runs``: places of words in ``numbers``, which are sorted; one row a bucket."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.uint16) if bits else np.zeros(len(key), np.uint16)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])).tolist() if len(order) else []
    rank = np.zeros(len(numbers), np.int64)
    for low, high in zip(edges, edges[1:]):
        o = order[low:high]
        mine = [w[o] for w in runs]
        here = np.zeros(len(numbers), bool)
        for w in mine:
            here[w] = True
        known = np.flatnonzero(here)
        rank[known] = np.arange(len(known))
        count = n[o]
        steps = np.diff(numbers[known], prepend=0)
        raw = b"".join([_planes(steps, int(steps.max())), *(_planes(rank[w], len(known)) for w in mine), _planes(count, int(count.max()))])
        data = len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[o[0]])], pa.int32()), pa.array([len(known)], pa.int32()), pa.array([len(o)], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "words", "runs", "data"])


def _by_bucket(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(bucket, numbers of its distinct words, places of each run's words among them, how often it occurs); a run may occur again."""
    parts: dict[int, list[tuple[int, int, bytes]]] = {}
    for batch in batches:
        for number, *part in zip(*(column.to_pylist() for column in batch.columns)):
            parts.setdefault(number, []).append(part)
    for number in sorted(parts):
        read = []
        for known, size, data in parts.pop(number):
            raw = memoryview(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))
            steps, rest = _numbers(raw, known)
            columns = []
            for _ in range(order + 1):
                column, rest = _numbers(rest, size)
                columns.append(column)
            read.append((np.cumsum(steps, dtype=np.int64), columns))
        numbers = _distinct(np.concatenate([words for words, _ in read]))
        places = [np.searchsorted(numbers, words) for words, _ in read]
        runs = [np.concatenate([place[columns[i]] for place, (_, columns) in zip(places, read)]) for i in range(order)]
        n = np.concatenate([columns[order].astype(np.int64) for _, columns in read])
        del read, places
        yield number, numbers, runs, n


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct sorted keys, place of one row of each, summed counts)."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], starts) if len(keys) else counts
    return keys[starts], order[starts], sums


def _counted(runs: list[np.ndarray], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct runs in order, how often each occurs); ``words``: how many words there are."""
    bits = max(1, int(words).bit_length())
    if bits * len(runs) > 63:
        _, at, n = _summed(_in_order(runs, words), np.ones(len(runs[0]), np.int64))
        return [w[at] for w in runs], n
    # A sort of packed runs is several times as fast as one that gives places; the runs are in what is sorted.
    keys = np.sort(_in_order(runs, words))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    n, keys = np.diff(np.append(starts, len(keys))), keys[starts]
    return [(keys >> (bits * k)) & ((1 << bits) - 1) for k in reversed(range(len(runs)))], n


def _in_order(runs: list[np.ndarray], words: int) -> np.ndarray:
    """Whole numbers that are equal and sorted as the runs are; ``words``: how many words there are."""
    bits = max(1, int(words).bit_length())
    key, used = runs[0].astype(np.int64), bits
    for w in runs[1:]:
        if used + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
            used = len(key).bit_length()
        key, used = (key << bits) | w, used + bits
    return key


def _count_rows(known: Vocabulary, bits: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        remembered("lm-count", lambda: None)

        def out() -> Iterator[pa.RecordBatch]:
            last, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            vocabulary, number = np.unique(np.append(last, START), return_inverse=True)
            start, number = number[-1], number[:-1]
            runs = [number if not back else _before(number, start, place, back) for back in reversed(range(order))]
            runs, n = _counted(runs, len(vocabulary))
            yield from _packed_rows(gram_keys([vocabulary[w] for w in runs]), known.numbers(vocabulary), runs, n, bits)

        for batch in batches:
            for part in text_slices(batch, "text"):
                (last,), sizes = read(part.column(0), 1)
                if not len(last):
                    continue
                held.append((last, _place(sizes)))
                size += len(last)
                if size > HELD:
                    yield from out()
                    size = 0
        if held:
            yield from out()
        give_back()

    return run


def _lower_rows(known: Vocabulary, folder: str, bits: int, order: int):
    """Sum and save the runs of ``order`` words, three or more, with their contexts; pass on each distinct run without its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, numbers, runs, n in _by_bucket(batches, order):
            vocabulary = known.words(numbers)
            _, at, n = _summed(_in_order(runs, len(vocabulary)), n)
            runs = [w[at] for w in runs]
            # Runs are in order, so a context's stand together.
            first = np.ones(len(n), bool)
            first[1:] = np.any([w[1:] != w[:-1] for w in runs[:-1]], axis=0)
            starts = np.flatnonzero(first)
            context = context_keys([vocabulary[w[starts]] for w in runs[:-1]])
            sums = {"followed": np.add.reduceat(n, starts), **{f"kinds{k}": np.add.reduceat(kind.astype(np.int64), starts) for k, kind in ((1, n == 1), (2, n == 2), (3, n > 2))}}
            by = np.argsort(context)
            hashstore.put_short(folder, "context", number, bits, context[by], {name: x[by] for name, x in sums.items()})
            hashstore.put(folder, f"of-{number}", np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64))
            key = gram_keys([vocabulary[w] for w in runs])
            by = np.argsort(key)
            hashstore.put_short(folder, "key", number, bits, key[by], {"n": n[by]})
            del context, sums, key, by, first
            runs, n = _counted(runs[1:], len(vocabulary))
            yield from _packed_rows(gram_keys([vocabulary[w] for w in runs]), numbers, runs, n, bits)
        give_back()

    return run


def _sum_rows(known: Vocabulary, folder: str, bits: int):
    def save(number: int, vocabulary: np.ndarray, runs: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, ...]:
        _, at, n = _summed(_in_order(runs, len(vocabulary)), n)
        mine, theirs = (w[at] for w in runs)
        key = pair_keys(vocabulary[mine], vocabulary[theirs])
        by = np.argsort(key)
        hashstore.put_short(folder, "key", number, bits, key[by], {"n": n[by]})

        def total(at: np.ndarray, what: np.ndarray | None = None) -> np.ndarray:
            return np.bincount(at, what, len(vocabulary)).astype(np.int64)

        kinds = [total(mine[n == 1]), total(mine[n == 2]), total(mine[n > 2])]
        return (vocabulary.view(np.int64), total(mine, n), *kinds, total(theirs), *(int((n == k).sum()) for k in (1, 2, 3, 4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, numbers, *table in _by_bucket(batches, 2):
            words, *values, c1, c2, c3, c4 = save(number, known.words(numbers), *table)
            for k in range(0, len(words), 1 << 17):
                stop = k + (1 << 17)
                m = len(words[k:stop])
                # The counts of counts of the bucket ride on its first row.
                ride = [pa.array(np.where((np.arange(m) == 0) & (k == 0), c, 0).astype(np.int64)) for c in (c1, c2, c3, c4)]
                yield pa.RecordBatch.from_arrays([pa.array(words[k:stop]), *(pa.array(x[k:stop]) for x in values), *ride], names=[x.split()[0] for x in STATS.split(", ")])
        give_back()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """[0, D1, D2, D3+] by the closed estimate; the fixed ones where a count of counts is missing."""
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(x, 0.0), float(k)) for k, x in zip((1, 2, 3), d[1:]))])


def train(docs: DataFrame, params: LmParams = LmParams()) -> Model | None:
    """Count all of ``docs``; None if there is no text."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("text").where(F.col("text").isNotNull())
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0]
    if not size:
        return None
    bits = int(np.clip(np.ceil(np.log2(max(1.0, size / params.bucket_bytes))), 0, params.max_bits))
    folders = [local_path(scratch(spark, f"lm-grams-{k}")) for k in range(2, params.order + 1)]
    for folder in folders:
        os.makedirs(folder, exist_ok=True)
    known = vocabulary_of(texts, bits)
    grams, before = texts.mapInArrow(_count_rows(known, bits, params.order), PACKED), None
    for k in range(params.order, 2, -1):
        # Each level is a job of its own, so that its shuffle is gone before the next one's.
        at = scratch(spark, f"lm-runs-{k - 1}")
        with shuffles_removed(spark):
            grams.repartitionById(1 << bits, F.col("bucket")).mapInArrow(_lower_rows(known, folders[k - 2], bits, k), PACKED).write.parquet(at)
        if before:
            discard(spark, before)
        grams, before = spark.read.schema(PACKED).parquet(at), at
    stats = grams.repartitionById(1 << bits, F.col("bucket")).mapInArrow(_sum_rows(known, folders[0], bits), STATS)
    names = [x.split()[0] for x in STATS.split(", ")][1:]
    with shuffles_removed(spark):
        words = materialize(stats.groupBy("w").agg(*[F.sum(n).alias(n) for n in names]), "lm-words")
    if before:
        discard(spark, before)
    discard(spark, f"file:{known.folder}")
    follows = F.col("follows")
    of = [F.sum(f"c{k}").alias(f"c{k}") for k in (1, 2, 3, 4)] + [F.sum(F.when(follows == k, 1).otherwise(0)).alias(f"f{k}") for k in (1, 2, 3, 4)] + [F.sum(F.when(follows > 2, 1).otherwise(0)).alias("more"), F.sum(follows).alias("types"), F.count("*").alias("v")]
    s = words.agg(*of).first()
    high, low = discounts(s["c1"], s["c2"], s["c3"], s["c4"]), discounts(s["f1"], s["f2"], s["f3"], s["f4"])
    # Left-over mass of the continuation level, spread evenly over the words that can follow and one unknown word.
    rest = (low[1] * s["f1"] + low[2] * s["f2"] + low[3] * s["more"]) / s["types"]
    unseen = float(rest / s["v"])
    off = F.when(follows == 0, 0.0).when(follows == 1, float(low[1])).when(follows == 2, float(low[2])).otherwise(float(low[3]))
    left = (F.col("n1") * float(high[1]) + F.col("n2") * float(high[2]) + F.col("n3") * float(high[3])) / F.col("followed")
    kept = words.select(F.col("w").alias("key"), ((follows - off) / float(s["types"]) + unseen).alias("p"), F.col("followed").cast("double").alias("followed"), F.when(F.col("followed") > 0, left).otherwise(1.0).alias("left"))
    word_bits = min(params.max_bits, bits)
    upper = [discounts(*sum(np.load(p) for p in Path(folder).glob("of-*.npy")).tolist()) for folder in folders[1:]]
    return Model(folders, bits, hashstore.write(kept, "lm-words", word_bits), word_bits, [high, *upper], unseen)


def _looked_up(keys: np.ndarray, store: hashstore.Store, columns: dict[str, float]) -> list[np.ndarray]:
    """The columns of a store for each key; ``columns``: what keys that aren't there get."""
    # Buckets are told by upper bits, of which sixteen are sorted in two passes and keep look-ups near one another.
    order = np.argsort((keys >> np.uint64(48)).astype(np.uint16), kind="stable") if store.bits <= 16 else np.argsort(keys)
    out = {c: np.full(len(keys), missing, np.float64) for c, missing in columns.items()}
    for number, which, at in store.find(keys[order]):
        places = order[which]
        for c, values in out.items():
            values[places] = store.values(c, number, at)
    return list(out.values())


def _numbered(context: np.ndarray, contexts: int, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pair of a context and a word, by number; the number of each row's pair)."""
    low, rows = int(words).bit_length(), int(len(word)).bit_length()
    if int(contexts).bit_length() + low + rows > 63:
        first, number = np.unique((context << low) | word, return_index=True, return_inverse=True)[1:]
        return first, number
    # Places are sorted with the pairs, which is faster than a sort that gives places.
    packed = np.sort((((context << low) | word) << rows) | np.arange(len(word)))
    at, pair = packed & ((1 << rows) - 1), packed >> rows
    fresh = np.concatenate([[True], pair[1:] != pair[:-1]])[: len(pair)]
    number = np.empty(len(word), np.int64)
    number[at] = np.cumsum(fresh) - 1
    return at[fresh], number


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.grams = [hashstore.ShortStore(folder, "key", model.bits) for folder in model.grams]
        self.contexts = [hashstore.ShortStore(folder, "context", model.bits) for folder in model.grams]
        self.words = hashstore.Store(model.words, "key", model.word_bits)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens, log2 probability) of each text."""
        (last,), sizes = read(texts, 1)
        out = np.zeros(len(sizes))
        if not len(last):
            return sizes, out
        place = _place(sizes)
        words, number = np.unique(np.append(last, START), return_inverse=True)
        start, number = number[-1], number[:-1]
        p, followed, left = _looked_up(words, self.words, {"p": self.model.unseen, "followed": 1, "left": 1})
        # Every distinct run of the slice is scored once: ``at`` is one of its places, ``run`` the number of each place's run.
        run, back, at = number, [number], np.arange(0)
        for k, (store, contexts, off) in enumerate(zip(self.grams, self.contexts, self.model.discounts), 2):
            before = _before(number, start, place, k - 1)
            if k == 2:
                context = before
            else:
                # Contexts are the runs that end one word earlier, and the start marks of a text.
                context = np.where(place > 0, np.append(0, run[:-1]), len(at))
                of = [np.append(words[w[at]], START) for w in reversed(back)]
                followed, *kinds = _looked_up(context_keys(of), contexts, {"followed": 0, "kinds1": 0, "kinds2": 0, "kinds3": 0})
                left = np.where(followed > 0, sum(off[i] * x for i, x in enumerate(kinds, 1)) / np.maximum(followed, 1), 1)
            back.append(before)
            at, now = _numbered(context, len(followed), number, len(words))
            (counts,) = _looked_up(gram_keys([words[w[at]] for w in reversed(back)]), store, {"n": 0})
            mine = context[at]
            p = (counts - off[np.minimum(counts, 3).astype(np.int64)]) / np.maximum(followed, 1)[mine] + left[mine] * p[run[at]]
            run = now
        logs = np.log2(p)[run]
        some = sizes > 0
        out[some] = np.add.reduceat(logs, (np.cumsum(sizes) - sizes)[some])
        return sizes, out


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer, kept from task to task."""
    return remembered(("lm", model.words), lambda: Scorer(model))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) of every row of ``docs``; no shuffle. log_prob is in bits."""
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("log_prob"), F.lit(None).cast("double").alias("perplexity"))

    def make():
        scorer = scorer_of(model)

        def kernel(part: pa.RecordBatch) -> list:
            sizes, logs = scorer.texts(part.column(1))
            none = sizes == 0
            per = np.exp2(-logs / np.maximum(sizes, 1))
            return [part.column(0).cast(pa.int64()), pa.array(sizes), pa.array(logs.round(4), mask=none), pa.array(per.round(4), mask=none)]

        return kernel

    return map_rows(docs, ["doc_id", "text"], SCHEMA, make, size=SCORED_BYTES)


def perplexity(docs: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """Every document of ``docs`` under the model of all of them."""
    return score(docs, train(docs, params))
