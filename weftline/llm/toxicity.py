"""Operator 5: toxicity by a support vector machine on a gap-weighted subsequence string kernel.

The kernel counts the character subsequences of length ``LENGTH`` that two words share, each occurrence weighted by
``DECAY`` to the power of the stretch that it spans, so an insult with gaps or inserted characters keeps most of its
similarity. A few landmark words give the Nyström map into a small feature space, where a linear machine is trained.

Labels belong to documents. Sentences of documents labelled clean are negative examples, as are all their words; a
sentence of a document labelled toxic is positive through its witness words: words that occur between several different
pairs of neighbours in toxic documents and in no clean one. Copies of the witnesses with inserted characters are added as positive examples.
A sentence's score is that of its most toxic word; a document is toxic when any of its sentences is.

Words are the letters, in lower case, of what white space separates; runs of single letters ("i d i o t") are also read
as one word. A word of more than ``LONGEST`` letters is read as overlapping stretches of it, and scored as its most toxic one.

Defined results:
- null or empty text, or text without words: score ``NO_WORDS``, not toxic, 0 toxic sentences;
- rows with a null id are scored like any other; repeated rows each give a row; an empty table gives no rows;
- no label at all, or none that is toxic: nothing is toxic;
- other columns of the input are ignored (``score``) or passed through unchanged (``clean``).
"""

from __future__ import annotations

import gc
import re
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import cutting
from weftline.llm.batches import give_back, keep_rows, map_rows, remembered, utf8_bytes
from weftline.runtime import BROADCAST_LIMIT_BYTES

LENGTH = 4
DECAY = 0.75
NO_WORDS = -9.0
SHORT = 8
#: Longer words are scored as overlapping stretches of this length.
LONGEST = 64
#: Tokens whose scores a worker remembers, 17 bytes each; beyond it the memory is emptied, which costs time only.
REMEMBERED = 3_000_000

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("toxicity", T.DoubleType()),
        T.StructField("toxic", T.BooleanType()),
        T.StructField("toxic_sentences", T.IntegerType()),
    ]
)
SENTENCE = re.compile(r"[.!?]+\s+|\n+")
NOT_LETTER = re.compile(r"[\W\d_]+")
SINGLE = re.compile(r"(?<![^\W\d_])[^\W\d_](?![^\W\d_])")
SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\s.\-_*]{1,2}){3,}[^\W\d_](?![^\W\d_])")


@dataclass(frozen=True)
class ToxicityParams:
    """max_labelled bounds the labelled documents that are read for training, half of them toxic."""

    max_labelled: int = 6_000
    min_places: int = 2
    landmarks: int = 28
    max_negatives: int = 60_000
    cost: float = 10.0
    rounds: int = 60


@dataclass
class ToxicityModel:
    landmarks: list[str]
    weights: np.ndarray  # on normalised kernel values with the landmarks; empty: nothing is toxic
    bias: float


# -- kernel


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint32)
    if words:
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        row = np.repeat(np.arange(len(words)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """(words, others): the gap-weighted subsequence kernel, not normalised. Words of any length."""
    out = np.zeros((len(words), len(others)), np.float32)
    if not words or not others:
        return out
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    if sizes.max() > SHORT >= sizes.min():
        # Short and long others apart: the work for each pair is in proportion to the longest of its kind.
        for kind in (np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)):
            out[:, kind] = kernel(words, [others[i] for i in kind])
        return out
    t = _codes(others, int(sizes.max()) or 1)
    width = t.shape[1]
    marked = np.where(t == 0, np.uint32(0xFFFFFFFF), t)  # padding matches nothing
    # spread[k, j] = DECAY ** (j - k): carries weight forward along the other word.
    gap = np.arange(width)[None, :] - np.arange(width)[:, None]
    spread = np.where(gap >= 0, np.float32(DECAY) ** np.maximum(gap, 0), 0).astype(np.float32)
    letters = np.unique(t[t > 0])
    places = np.stack([(t == c).sum(axis=1) for c in letters]).astype(np.float32)  # (letters, others)
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for at in range(0, len(order), 4096):
        rows = order[at : at + 4096]
        part = [words[i] for i in rows]
        s = _codes(part, len(part[-1]) or 1)
        held = np.zeros((len(part), len(letters)), np.float32)
        found = np.searchsorted(letters, s).clip(0, len(letters) - 1)
        who, where = np.nonzero(letters[found] == s)
        held[who, found[who, where]] = 1
        # Pairs that have fewer than LENGTH letters of the other word in common have kernel 0.
        left, right = np.nonzero(held @ places >= LENGTH)
        block = max(64, 3_000_000 // (width * LENGTH))
        for k in range(0, len(left), block):
            mine, theirs = s[left[k : k + block]], marked[right[k : k + block]]
            # carried[l]: weight of shared subsequences of length l + 1, up to the present ends of both words.
            carried = np.zeros((LENGTH - 1, len(mine), width), np.float32)
            total = np.zeros(len(mine), np.float32)
            for i in range(s.shape[1]):
                match = (mine[:, i, None] == theirs).astype(np.float32)
                match *= np.float32(DECAY * DECAY)
                for level in range(min(LENGTH - 1, i), 0, -1):
                    fresh = match[:, 1:] * carried[level - 1][:, :-1]
                    if level == LENGTH - 1:
                        total += fresh.sum(axis=1)
                    else:
                        carried[level] *= np.float32(DECAY)
                        carried[level] += fresh @ spread[1:]
                carried[0] *= np.float32(DECAY)
                carried[0] += match @ spread
            out[rows[left[k : k + block]], right[k : k + block]] = total
    return out


def self_kernel(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself."""
    out = np.zeros(len(words), np.float32)
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    at = 0
    while at < len(order):
        # Longer words in smaller blocks, so that the work space stays bounded.
        longest = len(words[order[min(len(order), at + 4096) - 1]]) or 1
        block = max(1, min(4096, 1_000_000 // (longest * LENGTH)))
        rows = order[at : at + block]
        at += block
        part = [words[i] for i in rows]
        s = _codes(part, len(part[-1]) or 1)
        width = s.shape[1]
        mine = np.where(s == 0, np.uint32(0xFFFFFFFF), s)
        gap = np.arange(width)[None, :] - np.arange(width)[:, None]
        spread = np.where(gap >= 0, np.float32(DECAY) ** np.maximum(gap, 0), 0).astype(np.float32)
        carried = np.zeros((LENGTH - 1, len(part), width), np.float32)
        for i in range(width):
            match = (s[:, i, None] == mine).astype(np.float32) * np.float32(DECAY * DECAY)
            for level in range(LENGTH - 1, 0, -1):
                fresh = np.zeros_like(match)
                fresh[:, 1:] = match[:, 1:] * carried[level - 1][:, :-1]
                if level == LENGTH - 1:
                    out[rows] += fresh.sum(axis=1)
                else:
                    carried[level] = carried[level] * np.float32(DECAY) + fresh @ spread
            carried[0] = carried[0] * np.float32(DECAY) + match @ spread
    return out


def similarity(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of words with a mark at their start, normalised so that a word has similarity 1 with itself, and squared."""
    words, landmarks = ["^" + w for w in words], ["^" + w for w in landmarks]
    raw = kernel(words, landmarks)
    own, theirs = self_kernel(words), self_kernel(landmarks)
    return (raw / np.sqrt(np.maximum(own[:, None] * theirs[None, :], 1e-20))) ** 2


# -- training


def word_in(token: str) -> str:
    """The word that a token between white space stands for; empty if there is none."""
    if token.isalpha():
        return token
    bare = NOT_LETTER.sub("", token)
    return bare if len(bare) >= LENGTH else ""


def pieces(word: str) -> list[str]:
    """The word, or overlapping stretches of a long one: the kernel's work grows with the square of a length."""
    return [word] if len(word) <= LONGEST else [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def spelled(row: list[str], lone: set[str]) -> set[str]:
    """Words spelled out in single letters. ``lone``: the tokens of the row that hold a letter standing alone.

    A spelled-out word is either inside one token or runs over adjacent tokens that all hold such letters.
    """
    if not lone:
        return set()
    at = [i for i, w in enumerate(row) if w in lone]
    found: set[str] = set()
    start = 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] != at[k - 1] + 1:
            stretch = row[at[start] : at[k - 1] + 1]
            if len(stretch) > 1 or len(stretch[0]) >= 2 * LENGTH - 1:
                for x in SPELLED.findall(" ".join(stretch)):
                    found.update(pieces(NOT_LETTER.sub("", x)))
            start = k
    return found


def words_of(text: str) -> set[str]:
    """The distinct words of a text, spelled-out ones included."""
    row = text.lower().split()
    distinct = set(row)
    lone = {w for w in distinct if (len(w) == 1 and w.isalpha()) or (not w.isalpha() and SINGLE.search(w))}
    return ({x for w in map(word_in, distinct) for x in pieces(w)} | spelled(row, lone)) - {""}


def _variants(word: str, rng: np.random.Generator) -> list[str]:
    """The word with a letter put in, and with one doubled."""
    k, c = int(rng.integers(1, len(word))), chr(97 + int(rng.integers(0, 26)))
    d = int(rng.integers(0, len(word)))
    return [word[:k] + c + word[k:], word[: d + 1] + word[d:]]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> np.ndarray:
    """Linear support vector machine (squared hinge) by Newton steps on the primal; the last feature is constant."""
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(v @ ridge @ v / 2 + (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum())

    for _ in range(rounds):
        inside = y * (x @ w) < 1
        xs, cs = x[inside], weight[inside][:, None]
        goal = np.linalg.solve(ridge + 2 * xs.T @ (cs * xs), 2 * xs.T @ (cs[:, 0] * y[inside]))
        size = 1.0
        while size > 1e-4 and loss(w + size * (goal - w)) > loss(w):
            size /= 2
        if np.abs(goal - w).max() < 1e-9:
            break
        w = w + size * (goal - w)
    return w


def train(rows: list[tuple[str, int]], params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """From (text, toxic) rows."""
    # Every fourth document is held out for the cut.
    held = [r for i, r in enumerate(rows) if i % 4 == 3] or rows
    clean: set[str] = set()
    rows = [r for i, r in enumerate(rows) if i % 4 != 3]
    for text, toxic in rows:
        if not toxic:
            clean |= words_of(text)
    beside: dict[str, set[tuple[str, str]]] = {}
    within: Counter[str] = Counter()
    n_toxic = sum(1 for _, toxic in rows if toxic)
    for text, toxic in rows:
        if toxic:
            row = [NOT_LETTER.sub("", w) for w in text.lower().split()]
            mine = {w for w in set(row) if len(w) >= LENGTH and w not in clean}
            within.update(mine)
            for before, w, after in zip(["", *row], row, [*row[1:], ""]):
                if w in mine:
                    beside.setdefault(w, set()).add((before, after))
    # Copies of one passage bring a word with the same neighbours again and again; a real witness has new ones. Chance
    # alone keeps a word with k places out of the clean documents with probability odds ** k; no word should pass by it.
    odds = n_toxic / max(1, len(rows))
    needed = max(params.min_places, np.log(max(2, len(beside))) / -np.log(min(0.9, odds)) if odds else 0)
    counts = Counter({w: len(s) for w, s in beside.items() if min(len(s), within[w]) >= needed and len(s) >= 0.5 * within[w]})
    witnesses = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    if not witnesses:
        return ToxicityModel([], np.zeros(0), NO_WORDS)
    # Landmarks: farthest first from the most frequent witness, so that every family of insults has one.
    pool = witnesses[:400]
    landmarks = [pool[0]]
    nearest = similarity(pool, landmarks)[:, 0]
    while len(landmarks) < min(params.landmarks, len(pool)):
        score = (1 - nearest) * np.log1p([counts[w] for w in pool])
        k = int(score.argmax())
        if nearest[k] > 0.9:
            break
        landmarks.append(pool[k])
        nearest = np.maximum(nearest, similarity(pool, [pool[k]])[:, 0])
    rng = np.random.default_rng(11)
    worth = {w: float(counts[w]) for w in witnesses[:400]}
    for w in witnesses[:200]:
        for v in _variants(w, rng):
            worth.setdefault(v, 0.2 * counts[w])
    positives = [w for w in worth if w not in clean]
    share = np.array([worth[w] for w in positives]) / np.mean([worth[w] for w in positives])
    negatives = sorted(clean)
    if len(negatives) > params.max_negatives:
        negatives = [negatives[i] for i in np.sort(rng.choice(len(negatives), params.max_negatives, replace=False))]
    km = similarity(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(km)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    pos, neg = similarity(positives, landmarks) @ root, similarity(negatives, landmarks) @ root
    hard = np.argsort(-np.linalg.norm(neg, axis=1), kind="stable")[:1500]
    rest = rng.choice(len(neg), min(len(neg), 1500), replace=False) if len(neg) else hard
    chosen = np.unique(np.concatenate([hard, rest])).astype(np.int64)
    for _ in range(3):
        x = np.vstack([pos, neg[chosen]])
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(chosen))])
        weight = np.concatenate([params.cost * share * max(1.0, len(chosen) / len(pos)), np.full(len(chosen), params.cost)])
        w = _machine(x, y, weight, params.rounds)
        wrong = np.flatnonzero(neg @ w[:-1] + w[-1] > -0.5)
        if not len(np.setdiff1d(wrong, chosen)):
            break
        chosen = np.union1d(chosen, wrong)
    model = ToxicityModel(landmarks, (root @ w[:-1]).astype(np.float64), 0.0)
    model.bias = -_cut(model, held)
    return model


def _cut(model: ToxicityModel, rows: list[tuple[str, int]]) -> float:
    """The document score from which held-out documents count as toxic: most toxic ones caught, a clean one lost weighing as 20."""
    scorer, texts = Scorer(model), [t for t, _ in rows]
    # A slice at a time, so that the driver needs little room.
    ends = np.cumsum([len(t) for t in texts]) // (1 << 19)
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    got = np.concatenate([scorer.texts(texts[a:b])[0] for a, b in zip(cuts, cuts[1:])])
    toxic = np.sort(got[[bool(y) for _, y in rows]])
    fine = np.sort(got[[not y for _, y in rows]])
    edges = np.unique(np.concatenate([got, [0.0, 1.0]]))
    cuts = (edges[1:] + edges[:-1]) / 2
    lost = np.searchsorted(toxic, cuts, "left") / max(1, len(toxic)) + 20 * (len(fine) - np.searchsorted(fine, cuts, "left")) / max(1, len(fine))
    best = np.flatnonzero(lost <= lost.min() + 1e-9)
    # The middle of the widest stretch of equally good cuts.
    width = (edges[1:] - edges[:-1])[best]
    return float(cuts[best[int(width.argmax())]])


def labelled(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> list[tuple[str, int]]:
    """The labelled documents with the smallest id hashes, up to half of max_labelled of each class."""
    labels = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    size = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    wanted = F.lit(False)
    for toxic, n in size.items():
        wanted = wanted | ((F.col("toxic") == toxic) & (draw < int(min(1.0, params.max_labelled / 2 / n) * (1 << 30)) + 1))
    some = labels.where(wanted)
    # About max_labelled ids are expected; they are counted before they are sent.
    side = F.broadcast(some) if some.count() * 16 <= BROADCAST_LIMIT_BYTES else some
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(side, "doc_id").collect()
    return [(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    model = train(labelled(docs, labels, params), params)
    gc.collect()
    give_back()
    return model


# -- scoring


@cache
def _between_blanks() -> np.ndarray:
    """By code point: what ``str.split`` separates by is a gap, anything else belongs to a token."""
    out = np.full(0x110000, cutting.WORD, np.uint8)
    out[[i for i, c in enumerate(cutting.code_points()) if c.isspace()]] = cutting.GAP
    return out


class Scorer:
    """Scores texts, remembering the scores of tokens by their keys, in sorted arrays."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.keys, self.values, self.lone = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool)
        self.known: dict[str, float] = {}  # of the words of toxic texts

    def words(self, words: list[str]) -> np.ndarray:
        return np.round(similarity(words, self.model.landmarks) @ self.model.weights + self.model.bias, 4)

    def _tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score, whether a letter stands alone in it) of each token."""
        parts = [pieces(word_in(t)) for t in tokens]
        flat = sorted({x for p in parts for x in p} - {""})
        score = dict(zip(flat, self.words(flat).tolist())) if flat else {}
        values = np.array([max(score[x] for x in p) if p[0] else NO_WORDS for p in parts])
        lone = np.fromiter(((len(t) == 1 and t.isalpha()) or (not t.isalpha() and SINGLE.search(t) is not None) for t in tokens), bool, len(tokens))
        return values, lone

    def _remember(self, keys: np.ndarray, tokens: list[str]) -> None:
        """``keys``: sorted, and none known yet."""
        done = [self._tokens(tokens[k : k + 20_000]) for k in range(0, len(tokens), 20_000)]
        values, lone = (np.concatenate(x) for x in zip(*done))
        if len(self.keys) + len(keys) > REMEMBERED:
            self.keys, self.values, self.lone = keys, values, lone
            return
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values, self.lone = np.insert(self.keys, at, keys), np.insert(self.values, at, values), np.insert(self.lone, at, lone)

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of sorted keys, which of them are remembered)."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text, and its number of toxic sentences."""
        score, count = np.full(len(texts), NO_WORDS), np.zeros(len(texts), np.int32)
        if not len(self.model.weights):
            return score, count
        data, offsets = utf8_bytes(pa.array([t.lower() if t else "" for t in texts], pa.string()))
        low, high, owner = cutting.runs(data, offsets, _between_blanks(), cutting.WORD)
        if not len(low):
            return score, count
        keys, first, number = np.unique(cutting.keys(data, low, high), return_index=True, return_inverse=True)
        _, hit = self._look(keys)
        if len(new := np.flatnonzero(~hit)):
            if len(self.keys) + len(new) > REMEMBERED:  # all of this slice's tokens must be there afterwards
                self.keys, new = np.zeros(0, np.uint64), np.arange(len(keys))
                self.values, self.lone = np.zeros(0), np.zeros(0, bool)
            self._remember(keys[new], [data[a:b].tobytes().decode() for a, b in zip(low[first[new]].tolist(), high[first[new]].tolist())])
        at, _ = self._look(keys)
        values, lone = self.values[at][number], self.lone[at][number]
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        score[owner[starts]] = np.maximum.reduceat(values, starts)
        # A spelled-out word is in one token that is long enough, or runs over adjacent tokens with letters that stand alone.
        spelled_out = lone & (high - low >= 2 * LENGTH - 1)
        spelled_out[:-1] |= lone[:-1] & lone[1:] & (owner[:-1] == owner[1:])
        letters = {}
        for i in np.unique(owner[spelled_out]).tolist():
            row = texts[i].lower().split()
            letters[i] = spelled(row, {w for w in set(row) if (len(w) == 1 and w.isalpha()) or (not w.isalpha() and SINGLE.search(w))})
        found = self._words(set().union(*letters.values()))
        for i, words in letters.items():
            score[i] = max([score[i], *(found[w] for w in words)])
        sentences = {i: [words_of(s) for s in SENTENCE.split(texts[i])] for i in np.flatnonzero(score > 0).tolist()}
        found = self._words(set().union(*(w for row in sentences.values() for w in row)))
        for i, row in sentences.items():
            count[i] = max(1, sum(1 for words in row if any(found[w] > 0 for w in words)))
        return score, count

    def _words(self, words: set[str]) -> dict[str, float]:
        if len(self.known) > REMEMBERED // 20:  # words are held as such, so fewer of them
            self.known = {}
        if new := sorted(words - self.known.keys()):
            self.known.update(zip(new, self.words(new).tolist()))
        return {w: self.known[w] for w in words}


def scorer_of(name: str, model) -> Scorer:
    """The worker's scorer of a broadcast model, with its memory of words, kept from task to task."""
    return remembered(name, lambda: Scorer(model.value))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, toxicity, toxic, toxic_sentences) of every row of ``docs``; no shuffle."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        scorer = scorer_of(name, shared)

        def kernel_of(part: pa.RecordBatch) -> list:
            value, count = scorer.texts(part.column(1).to_pylist())
            return [part.column(0).cast(pa.int64()), pa.array(value), pa.array(value > 0), pa.array(count)]

        return kernel_of

    return map_rows(docs, ["doc_id", "text"], SCHEMA, make)


def clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns unchanged; no shuffle."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def make():
        scorer = scorer_of(name, shared)
        return lambda texts: scorer.texts(texts.to_pylist())[0] <= 0

    return keep_rows(docs, make)
