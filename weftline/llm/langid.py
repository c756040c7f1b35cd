"""Operator 9: language identification by prediction by partial matching (PPM).

One variable-order byte context tree per language is trained on a bounded sample of labelled rows and then frozen.
The code length of a text under a language is the exact sum, over all of its bytes, of ``-log2 p(byte | longest known
context)``, where each step down to a shorter context pays that context's escape probability (method C: a context seen
``n`` times with ``d`` different followers escapes with ``d/(n+d)``). The trees of all languages are laid over one
another as a finite automaton whose state is the longest known context, so scoring is two table look-ups a byte, run
over many stretches of text at once; each stretch first re-reads ``ORDER`` bytes, which is all the history a state can hold,
so the sums equal a byte-by-byte pass.

Defined results:
- null or empty text, or text without any letter: language ``und``, 0 bits, not accepted;
- a text whose best language needs more than ``max_bits_per_byte`` (plain bytes need 8), or is less than ``min_margin`` bits a byte
  ahead of the second: ``und``, not accepted; so equal code lengths of two languages are ``und`` unless ``min_margin`` is 0, when
  the language first in alphabetical order is taken;
- rows with a null id are scored like any other; repeated rows each give a row; an empty table gives no rows;
- other columns of the input are ignored (``identify``) or passed through unchanged (``accepted``).
- rows with a null language label don't train; no labelled row at all: every text is ``und``.
"""

from __future__ import annotations

import gc
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.batches import give_back, keep_rows, map_rows, remembered, utf8_bytes

ORDER = 4
STRETCH = 256
#: Code lengths are whole multiples of 1/SCALE bit, so that sums don't depend on their order.
SCALE = 1024
#: Contexts whose costs are copied at a time.
BLOCK = 2048

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("pred_lang", T.StringType()),
        T.StructField("bits_per_byte", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class LangIdParams:
    """docs_per_lang bounds the labelled training sample (whole texts); max_contexts bounds the model's size."""

    docs_per_lang: int = 250
    max_contexts: int = 24_000
    min_count: int = 4
    max_bits_per_byte: float = 7.5
    min_margin: float = 0.02


@dataclass
class PpmModel:
    languages: list[str]
    classes: np.ndarray  # byte -> symbol; the last symbol is padding
    step: np.ndarray  # (states * symbols) -> state
    cost: np.ndarray  # (states * symbols, languages) in 1/SCALE bit
    symbols: int
    max_bits_per_byte: float
    min_margin: float


def _counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (order + 1)-grams, packed big-endian into 64 bits, and their counts."""
    parts = []
    for t in texts:
        b = np.frombuffer(t, np.uint8).astype(np.uint64)
        n = len(b) - order
        if n <= 0:
            continue
        key = np.zeros(n, np.uint64)
        for k in range(order + 1):
            key = (key << np.uint64(8)) | b[k : k + n]
        parts.append(key)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(parts), return_counts=True)


@dataclass
class _Tree:
    """What follows a language's contexts of one length: an entry a pair of context and byte, in order."""

    context: np.ndarray  # distinct contexts, packed big-endian
    seen: np.ndarray  # how often each occurs
    kinds: np.ndarray  # how many different bytes follow each
    of: np.ndarray  # by pair: place of its context
    byte: np.ndarray
    count: np.ndarray


def _tree(texts: list[bytes], order: int) -> _Tree:
    keys, count = _counts(texts, order)
    before = keys >> np.uint64(8)
    first = np.concatenate([[True], before[1:] != before[:-1]])[: len(keys)]
    starts = np.flatnonzero(first)
    seen = np.add.reduceat(count, starts) if len(starts) else count
    return _Tree(before[starts], seen, np.diff(np.append(starts, len(keys))), np.cumsum(first) - 1, (keys & np.uint64(255)).astype(np.uint8), count)


def _chosen(samples: list[list[bytes]], params: LangIdParams) -> list[bytes]:
    """The most frequent contexts; a prefix or suffix of a context is at least about as frequent, and is added if it isn't."""
    parts = []
    for order in range(ORDER + 1):
        context, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for texts in samples:
            t = _tree(texts, order)
            both, n = np.concatenate([context, t.context]), np.concatenate([n, t.seen])
            del t
            by = np.argsort(both, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], both[by][1:] != both[by][:-1]])[: len(by)])
            context, n = both[by[starts]], np.add.reduceat(n[by], starts) if len(starts) else n
        often = n >= params.min_count
        parts.append((n[often], np.full(int(often.sum()), order), context[often]))
    n, size, context = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((context, size, -n))[: params.max_contexts + 1]
    chosen = {b""}
    for key, length in zip(context[by].tolist(), size[by].tolist()):
        if len(chosen) >= params.max_contexts:
            break
        text = key.to_bytes(length, "big")
        for i in range(length):
            for j in range(i + 1, length + 1):
                chosen.add(text[i:j])
    return sorted(chosen, key=lambda s: (len(s), s))


def train(samples: dict[str, list[bytes]], params: LangIdParams = LangIdParams()) -> PpmModel:
    """Frozen context trees of every language, as one automaton.

    The driver has little room, so trees are arrays that are made again when they are needed, one language and length at a time.
    """
    languages = sorted(k for k, v in samples.items() if any(v))
    contexts = _chosen([samples[lang] for lang in languages], params)
    number = {s: i for i, s in enumerate(contexts)}
    shorter = np.array([number[s[1:]] for s in contexts])
    prefix = np.array([number[s[:-1]] for s in contexts])
    last = np.array([s[-1] if s else 0 for s in contexts])
    packed = np.array([int.from_bytes(s, "big") for s in contexts], np.uint64)
    edges = np.searchsorted([len(s) for s in contexts], np.arange(ORDER + 2)).tolist()
    levels = [slice(low, high) for low, high in zip(edges, edges[1:])]
    del number

    seen = sorted({b for lang in languages for t in samples[lang] for b in set(t)})
    other, pad, symbols = len(seen), len(seen) + 1, len(seen) + 2
    classes = np.full(256, other, np.uint8)
    classes[seen] = np.arange(len(seen), dtype=np.uint8)
    step = np.zeros((len(contexts), symbols), np.int32)
    for level, longer in zip(levels, [*levels[1:], slice(0, 0)]):
        if level.start:
            step[level] = step[shorter[level]]
        step[prefix[longer], classes[last[longer]]] = np.arange(longer.start, longer.stop)
    step[:, pad] = 0
    step *= symbols
    whole = np.zeros((len(contexts), symbols, max(1, len(languages))), np.int32)
    for k, lang in enumerate(languages):
        cost = np.full((len(contexts), symbols), 8.0)
        for order, level in enumerate(levels):
            if level.start == level.stop:
                continue
            for low in range(max(1, level.start), level.stop, BLOCK):
                high = min(level.stop, low + BLOCK)
                np.take(cost, shorter[low:high], axis=0, out=cost[low:high])
            t = _tree(samples[lang], order)
            place = np.minimum(np.searchsorted(packed[level], t.context), level.stop - level.start - 1)
            known = packed[level][place] == t.context
            place += level.start
            escape = np.log2((t.seen + t.kinds) / t.kinds)
            for mine in np.array_split(np.flatnonzero(known), len(known) // BLOCK + 1):
                cost[place[mine]] += escape[mine, None]
            pairs = np.flatnonzero(known[t.of])
            of = t.of[pairs]
            cost[place[of], classes[t.byte[pairs]]] = np.log2((t.seen + t.kinds)[of] / t.count[pairs])
        cost[:, pad] = 0
        cost *= SCALE
        cost += 0.5
        whole[:, :, k] = np.floor(cost, out=cost)
        del cost
    return PpmModel(languages, classes, step.reshape(-1), whole.reshape(step.size, -1), symbols, params.max_bits_per_byte, params.min_margin)


def code_lengths(model: PpmModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): exact code length of every whole text, in 1/SCALE bit."""
    n, k = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, k), np.int64)
    lengths = np.diff(offsets)
    per = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(n), per)
    if not len(owner) or not k:
        return out
    first = np.repeat(np.cumsum(per) - per, per)
    start = offsets[owner] + (np.arange(len(owner)) - first) * STRETCH
    low, high = offsets[owner], offsets[owner + 1]
    symbols = np.append(model.classes[data], np.uint8(model.symbols - 1))
    state = np.zeros(len(owner), np.int32)
    acc = np.zeros((len(owner), k), np.int32)
    for t in range(-ORDER, STRETCH):
        at = start + t
        at = np.where((at >= low) & (at < high), at, len(symbols) - 1)
        index = state + symbols[at]
        if t >= 0:
            acc += model.cost.take(index, axis=0)
        state = model.step.take(index)
    np.add.at(out, owner, acc)
    return out


def decide(model: PpmModel, array: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Language, bits a byte, margin to the second language (bits a byte) and acceptance of every text."""
    data, offsets = utf8_bytes(array)
    lengths = np.diff(offsets)
    letter = pc.match_substring_regex(array.cast(pa.large_string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
    if not model.languages:
        return ["und"] * len(lengths), np.zeros(len(lengths)), np.zeros(len(lengths)), np.zeros(len(lengths), bool)
    bits = code_lengths(model, data, offsets)
    size = np.maximum(lengths, 1) * SCALE
    best = bits.argmin(axis=1)
    ordered = np.sort(bits, axis=1)
    per_byte = ordered[:, 0] / size
    margin = (ordered[:, 1] - ordered[:, 0]) / size if bits.shape[1] > 1 else np.zeros(len(size))
    fine = letter & (lengths > 0) & (per_byte <= model.max_bits_per_byte)
    if bits.shape[1] > 1:
        fine &= margin >= model.min_margin
    names = np.array([*model.languages, "und"], dtype=object)[np.where(fine, best, len(model.languages))]
    return names.tolist(), per_byte, margin, fine


def sample(docs: DataFrame, params: LangIdParams) -> dict[str, list[bytes]]:
    """The labelled rows with the smallest id hashes, ``docs_per_lang`` of each language."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not per_lang:
        return {}
    # A hash threshold keeps the sample bounded without a sort: 1.5 times what is wanted is expected to pass it.
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in per_lang.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(min(1.0, (1.5 * params.docs_per_lang + 20) / n) * (1 << 30))))
    got = rows.where(wanted).select("lang", draw.alias("draw"), "doc_id", "text").collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["draw"], r["doc_id"] if r["doc_id"] is not None else -1, r["text"])):
        if len(texts := out.setdefault(r["lang"], [])) < params.docs_per_lang:
            texts.append(r["text"].encode())
    return out


def fit(docs: DataFrame, params: LangIdParams = LangIdParams()) -> PpmModel:
    model = train(sample(docs, params), params)
    # The trees are large while they are built.
    gc.collect()
    give_back()
    return model


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """(doc_id, pred_lang, bits_per_byte, margin, accepted) of every row of ``docs``; no shuffle."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        m = remembered(name, lambda: shared.value)

        def kernel(part: pa.RecordBatch) -> list:
            names, bits, margin, fine = decide(m, part.column(1))
            return [part.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(bits.round(6)), pa.array(margin.round(6)), pa.array(fine)]

        return kernel

    return map_rows(docs, ["doc_id", "text"], SCHEMA, make)


def accepted(docs: DataFrame, model: PpmModel) -> DataFrame:
    """The rows of ``docs`` whose language is identified, all columns unchanged; no shuffle."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        m = remembered(name, lambda: shared.value)
        return lambda texts: decide(m, texts)[3]

    return keep_rows(docs, make)
