"""What a unit of messages becomes: summaries, tags and their size guards, as a kernel that workers run."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import kernels as K
from weftline.operators.options import CompressOptions

DASH = chr(0x2014)
RESULT = "out string, reason string, summary_id string"


def summary_id(ids: Sequence[str], prefix: str) -> str:
    """From the sorted ids: a 32-bit hash in base 36. It names a summary; it doesn't secure it."""
    key = "\0".join(sorted(ids, key=lambda x: x.encode("utf-16-be")))
    units = key.encode("utf-16-le")
    h = 5381
    for k in range(0, len(units), 2):
        h = (h * 33 + units[k] + 256 * units[k + 1]) & 0xFFFFFFFF
    digits = ""
    while True:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        if not h:
            return prefix + digits


class Emitter:
    """Every method gives (text, reason); a text of None leaves the messages as they are."""

    def __init__(self, options: CompressOptions):
        self.options = options
        self.depth = "gentle" if options.compression_depth == "auto" else options.compression_depth

    def budget(self, text: str) -> int:
        return K.budget(K.size(text), None if self.depth == "gentle" else len(K.entities(text, 500)), self.depth)

    def summary(self, text: str, budget: int) -> str:
        o = self.options
        if o.token_classifier:
            short = K.join_kept(o.token_classifier(text))
            return short if K.size(short) < K.size(text) else K.summarize(text, budget)
        if o.discourse_aware and not o.summarizer:
            return K.summarize_units(text, budget)
        if o.summarizer:
            try:
                short = o.summarizer(text)
            except Exception:  # the caller's own function: the picker takes over
                short = None
            return short if isinstance(short, str) and 0 < K.size(short) < K.size(text) else K.summarize(text, budget)
        return K.summarize(text, budget, K.entropy_scores(text, o.entropy_scorer, o.entropy_scorer_mode) if o.entropy_scorer else None)

    def formatted(self, summary: str, name: str, merged: int = 1, named: Sequence[str] = ()) -> str:
        head = f"[summary#{name}: " if self.options.embed_summary_id else "[summary: "
        return head + summary + (f" ({merged} messages merged)" if merged > 1 else "") + (f" | entities: {', '.join(named)}" if named else "") + "]"

    def prose(self, contents: list[str], name: str) -> tuple[str | None, str]:
        text, n, least = " ".join(contents), len(contents), self.options.relevance_threshold
        if least and (top := K.best_sentence_score(text)) < least:
            return f"[{n} message{'s' if n > 1 else ''} of general discussion omitted]", f"relevance_dropped:{top}"
        if self.depth == "aggressive":
            summary = K.entity_stub(text)
        elif K.is_structured(text):
            summary = K.summarize_structured(text, self.budget(text))
        else:
            summary = self.summary(text, self.budget(text))
        room = sum(map(K.size, contents))
        named = K.entities(text, max(3, min(K.rounded(K.size(text) / 200), 30)))
        for out in (self.formatted(summary, name, n, named), self.formatted(summary, name, n)):
            if K.size(out) < room:
                return out, "merged_compressed" if n > 1 else "compressible_prose"
        return None, "merge_reverted" if n > 1 else "single_reverted"

    def superseded(self, text: str, by: str, signal: str) -> tuple[str | None, str]:
        tag = f"[{self.options.namespace}superseded by {by}"
        for out in (f"{tag} ({signal}) {DASH} {self.summary(text, self.budget(text))}]", f"{tag} {DASH} {signal}]"):
            if K.size(out) < K.size(text):
                return out, f"contradicted:{signal}"
        return None, "contradiction_reverted"

    def code(self, text: str, name: str) -> tuple[str | None, str]:
        pieces, blocks = K.split_code(text)
        prose = " ".join(pieces)
        out = self.formatted(self.summary(prose, self.budget(prose)), name) + "\n\n" + "\n\n".join(blocks)
        return (out, "code_split") if K.size(out) < K.size(text) else (None, "code_split_reverted")

    def adapted(self, text: str, at: int) -> tuple[str | None, str]:
        adapter = self.options.adapters[at]
        prose = " ".join(adapter.compressible(text))
        out = adapter.rebuild(adapter.preserved(text), self.summary(prose, self.budget(prose)) if prose else "")
        return (out, f"adapter:{adapter.name}") if K.size(out) < K.size(text) else (None, f"adapter_reverted:{adapter.name}")

    def unit(self, kind: str, contents: list[str], ids: list[str], note: str | None, signal: str | None, near: float | None, room: int | None, at: int | None, tag: str | None) -> dict:
        name = summary_id(ids, self.options.summary_id_prefix)
        space = self.options.namespace
        if kind == "prose":
            out, reason = self.prose(contents, name)
        elif kind == "superseded":
            out, reason = self.superseded(contents[0], note, signal)
        elif kind == "code":
            out, reason = self.code(contents[0], name)
        elif kind == "adapted":
            out, reason = self.adapted(contents[0], at)
        elif kind == "copy":
            out, reason = f"[{space}dup of {note} {DASH} {room} chars]", "exact_duplicate"
        elif kind == "near":
            out, reason = f"[{space}near-dup of {note} {DASH} {room} chars, ~{K.rounded(near * 100)}% match]", "fuzzy_duplicate"
        else:  # a chain or a cluster, whose text its operator wrote
            out, reason = tag, signal
        return {"out": out, "reason": reason, "summary_id": name if out is not None else None}


def emitter(options: CompressOptions):
    """An Arrow function from a unit's kind, contents, ids and notes to RESULT; null where the kind is null."""
    made = Emitter(options)
    schema = pa.struct([(n, pa.string()) for n in ("out", "reason", "summary_id")])

    def run(kind: pa.Array, contents: pa.Array, ids: pa.Array, note: pa.Array, signal: pa.Array, near: pa.Array, room: pa.Array, at: pa.Array, tag: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (kind, contents, ids, note, signal, near, room, at, tag)))
        return pa.array([None if r[0] is None else made.unit(*r) for r in rows], schema)

    return F.arrow_udf(run, RESULT)
