"""Learning from outcomes: what compression lost or kept in vain, options refined by it, and pairs to train a model on."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.prompts import SummarizerOptions, string_list, strip_fences
from weftline.operators.quality_metrics import paired

#: Tokens from which a history, and a single observation, are worth compressing (published ablations of agent contexts).
HISTORY_TOKENS = 4096
OBSERVATION_TOKENS = 1024


@dataclass(frozen=True)
class Feedback:
    lost_patterns: tuple[str, ...] = ()
    suggested_terms: tuple[str, ...] = ()
    guidelines: tuple[str, ...] = ()


@dataclass(frozen=True)
class OverPreservation:
    unnecessary_patterns: tuple[str, ...] = ()
    removable_terms: tuple[str, ...] = ()
    tightening_guidelines: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pair:
    original: tuple[str, ...]
    compressed: tuple[str, ...]
    success: bool
    error: str | None = None


def _case(p: Pair) -> str:
    text = lambda parts: "\n---\n".join(x for x in parts if x)
    return f"\n### Original:\n{text(p.original)}\n### Compressed:\n{text(p.compressed)}\n" + (f"### Error: {p.error}\n" if p.error else "")


def _asked(*names: str) -> str:
    return "\nAnswer with a JSON object only, each key with a list of strings: " + ", ".join(names)


def contrastive_prompt(pairs: list[Pair]) -> str:
    """Failed cases beside those that went well."""
    failed, fine = [p for p in pairs if not p.success], [p for p in pairs if p.success]
    out = "Find out what compression lost that made tasks fail.\n\n## Failed cases\n" + "".join(map(_case, failed))
    if fine:
        out += "\n## Successful cases\n" + "".join(map(_case, fine))
    return out + _asked("lostPatterns", "suggestedTerms", "guidelines")


def over_preservation_prompt(pairs: list[Pair]) -> str:
    return "Find out what compression kept that tasks didn't need.\n\n## Successful cases\n" + "".join(_case(p) for p in pairs if p.success) + _asked("unnecessaryPatterns", "removableTerms", "tighteningGuidelines")


@dataclass
class FeedbackCollector:
    """Gathers cases and asks ``ask`` about them; without a case of the kind in question nothing is asked."""

    ask: Callable[[str], str]
    pairs: list[Pair] = field(default_factory=list)

    def add(self, original: list[str], compressed: list[str], success: bool, error: str | None = None) -> None:
        self.pairs.append(Pair(tuple(original), tuple(compressed), success, error))

    def add_table(self, cases: DataFrame, limit: int) -> None:
        """Cases of a table (original array, compressed array, success, error): ``limit`` of them, failures first, as a prompt holds no more."""
        for r in cases.orderBy("success", F.xxhash64("original")).limit(limit).collect():
            self.add(r["original"], r["compressed"], r["success"], r["error"])

    def analyze(self) -> Feedback:
        if all(p.success for p in self.pairs):
            return Feedback()
        said = json.loads(strip_fences(self.ask(contrastive_prompt(self.pairs))))
        return Feedback(*(tuple(string_list(said.get(k))) for k in ("lostPatterns", "suggestedTerms", "guidelines")))

    def analyze_over_preservation(self) -> OverPreservation:
        if not any(p.success for p in self.pairs):
            return OverPreservation()
        said = json.loads(strip_fences(self.ask(over_preservation_prompt(self.pairs))))
        return OverPreservation(*(tuple(string_list(said.get(k))) for k in ("unnecessaryPatterns", "removableTerms", "tighteningGuidelines")))


def merged(terms: tuple[str, ...], more: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys([*terms, *more]))


def _guided(system: str, guidelines: tuple[str, ...]) -> str:
    bullets = "\n".join(f"- {g}" for g in guidelines)
    return f"{system}\n\n{bullets}" if system and bullets else system or bullets


def refine_summarizer(options: SummarizerOptions, found: Feedback) -> SummarizerOptions:
    """Add what was lost."""
    return replace(options, preserve_terms=merged(options.preserve_terms, found.suggested_terms), system=_guided(options.system, found.guidelines))


def tighten_summarizer(options: SummarizerOptions, found: OverPreservation) -> SummarizerOptions:
    """Take away what wasn't needed."""
    kept = tuple(t for t in options.preserve_terms if t not in found.removable_terms)
    return replace(options, preserve_terms=kept, system=_guided(options.system, found.tightening_guidelines))


def refine_candidates(ask: Callable[[str], str], options: SummarizerOptions, found: Feedback, count: int = 5) -> list[SummarizerOptions]:
    """Up to ``count`` different refinements, to be tried against one another."""
    listed = lambda x, sep: sep.join(x) or "(none)"
    prompt = (
        f"Propose {count} different settings of a summariser that each answer this feedback in another way.\n\n"
        f"Terms kept now: {listed(options.preserve_terms, ', ')}\nInstructions now: {options.system or '(none)'}\n"
        f"Lost: {listed(found.lost_patterns, '; ')}\nSuggested terms: {listed(found.suggested_terms, ', ')}\nGuidelines: {listed(found.guidelines, '; ')}\n\n"
        f'Answer with a JSON list of {count} objects only: {{"preserveTerms": [strings], "guidelines": [strings]}}'
    )
    said = json.loads(strip_fences(ask(prompt)))
    if not isinstance(said, list):
        raise ValueError("the answer should be a list of candidates")
    return [refine_summarizer(options, Feedback((), tuple(string_list(c.get("preserveTerms"))), tuple(string_list(c.get("guidelines"))))) for c in said[:count]]


def distillation_pairs(messages: DataFrame, store: DataFrame) -> DataFrame:
    """(conv_id, pos, input, output): originals and what they became, where both have text and differ."""
    pairs = paired(messages, store).select("conv_id", "pos", F.col("before").alias("input"), F.col("content").alias("output"))
    return pairs.where("input <> '' and output <> '' and input <> output")
