"""Row-local text kernels that Arrow functions call: sentence picking, discourse units, token dropping, structured output.

Lengths and cuts are in UTF-16 units, and ``\\b``, ``\\w`` and ``\\d`` are ASCII, as everywhere in the engine. All functions take
and give plain strings; an empty string is a text without sentences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

#: White space that ends of texts are freed from: ECMAScript's, which is wider than ASCII and narrower than Python's.
BLANK = "\t\n\x0b\x0c\r \xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: What ends a line for ``.``.
LINE_ENDS = "\n\r" + chr(0x2028) + chr(0x2029)


def size(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > chr(0xFFFF) for c in text) if not text.isascii() else len(text)


def head(text: str, n: int) -> str:
    """The first ``n`` UTF-16 units; a pair that the cut would split is left out."""
    cut = text[: max(0, n)]
    if cut.isascii():
        return cut
    while size(cut) > n:
        cut = cut[:-1]
    return cut


def trim(text: str) -> str:
    return text.strip(BLANK)


def rounded(x: float) -> int:
    """Half up."""
    return math.floor(x + 0.5)


# -- sentences

SENTENCE = re.compile(r"[^.!?\n]+[.!?]+")


def _re(pattern: str, flags: int = 0) -> re.Pattern[str]:
    return re.compile(pattern, re.ASCII | flags)


CAMEL, PASCAL, SNAKE = (_re(p) for p in (r"\b[a-z]+(?:[A-Z][a-z]+)+\b", r"\b(?:[A-Z][a-z]+){2,}\b", r"\b[a-z]+(?:_[a-z]+)+\b"))
STATUS = _re(r"\b(?:ERROR|FAIL|PASS|WARN|WARNING)\b")
PAIRS = (_re(r"\b\d+(?:\.\d+)?\s*(?:%|[kmgt]b|ms|nodes?|replicas?|requests?|retries?|seconds?|threads?|workers?)\b", re.I), _re(r"\b[b-df-hj-np-tv-xz]{3,}\b", re.I), _re(r"\S+\.\w+:\d+:"))
# Word lists below are parity data: which words weigh is the behaviour to match; their order means nothing.
STRESSED = _re(r"\b(?:" + "|".join(sorted("always critical crucial essential however importantly must never notably require[ds]? significant specifically".split()) + ["in particular", "key point", "note that"]) + r")\b", re.I)
ARGUED = _re(r"\b(?:" + "|".join("accordingly consequently hence therefore thus".split() + ["as a result", "given that", "in conclusion", "it follows that", "this (?:means|proves|implies) that", "we can (?:infer|deduce|conclude)"]) + r")\b", re.I)
FILLER = _re(
    r"(?:" + "|".join(sorted("absolutely alright awesome certainly cool exactly fantastic great i'll indeed nice no noted now okay ok perfect right so sure thanks understood well wonderful yes".split(), reverse=True) + ["got it", "i (?:can|would|see|understand)", "let me", "makes sense", "no (?:problem|worries)", "of course", "sounds good", "thank you", "will do"]) + r")[\s,.!?]",
    re.I,
)


def sentence_score(s: str) -> int:
    score = 3 * sum(len(p.findall(s)) for p in (CAMEL, PASCAL, SNAKE, STATUS)) + 2 * sum(len(p.findall(s)) for p in PAIRS)
    score += 4 * bool(STRESSED.search(s)) + 3 * bool(ARGUED.search(s)) + 2 * (40 <= size(s) <= 120)
    return score - 10 * bool(FILLER.match(trim(s)))


def split_sentences(text: str) -> list[str]:
    found = SENTENCE.findall(text)
    if not found:
        return [trim(text)] if trim(text) else []
    return [x for x in map(trim, found) if x]


def best_sentence_score(text: str) -> int:
    found = SENTENCE.findall(text)
    return max(sentence_score(trim(s)) for s in found) if found else sentence_score(trim(text))


def picker_sentences(text: str) -> list[list[str]]:
    """Sentences by paragraph; a paragraph without an end mark is one sentence."""
    out = []
    for paragraph in re.split(r"\n\n+", text):
        if trim(paragraph):
            out.append([trim(s) for s in SENTENCE.findall(paragraph)] or [trim(paragraph)])
    return out


def summarize(text: str, budget: int, scores: Sequence[float] | None = None) -> str:
    """The best sentences within ``budget`` characters, in reading order; the best of each paragraph go first.

    ``scores`` replaces the sentences' own scores, in the order of ``picker_sentences``; those past its end keep their own.
    """
    found: list[tuple[str, float, bool]] = []
    for parts in picker_sentences(text):
        values = [scores[len(found) + i] if scores is not None and len(found) + i < len(scores) else sentence_score(s) for i, s in enumerate(parts)]
        top = values.index(max(values))
        found += [(s, v, i == top) for i, (s, v) in enumerate(zip(parts, values))]
    if not found:
        return trim(head(text, budget))
    taken, seen, used = [], set(), 0
    for first in (True, False):
        for i in sorted((i for i, f in enumerate(found) if f[2] is first and f[1] >= 0), key=lambda i: -found[i][1]):
            room = size(found[i][0]) + (5 if taken else 0)
            if found[i][0] not in seen and used + room <= budget:
                taken.append(i)
                seen.add(found[i][0])
                used += room
    if not taken:
        best = trim(head(max(found, key=lambda f: f[1])[0], budget))
        return head(best, budget - 3) + "..." if size(best) > budget - 3 else best
    return _fit(" ... ".join(found[i][0] for i in sorted(taken)), budget)


def _fit(text: str, budget: int) -> str:
    return head(text, budget - 3) + "..." if size(text) > budget else text


# -- outside scores


def normalize_scores(scores: Sequence[float]) -> list[float]:
    """Scaled to 0 to 1; all equal gives one half each."""
    if not scores:
        return []
    low, high = min(scores), max(scores)
    return [0.5] * len(scores) if low == high else [(s - low) / (high - low) for s in scores]


def combine_scores(own: Sequence[float], outside: Sequence[float], weight: float = 0.6) -> list[float]:
    if len(own) != len(outside):
        raise ValueError("both lists of scores need one length")
    return [a * (1 - weight) + b * weight for a, b in zip(normalize_scores(own), normalize_scores(outside))]


def entropy_scores(text: str, scorer: Callable[[list[str]], Sequence[float]], mode: str = "augment") -> list[float]:
    """Scores of the picker's sentences from an outside scorer: as they are, or mixed with the picker's own, to 20.

    The scorer sees the picker's own sentences, so that a score always belongs to its sentence.
    """
    sentences = [s for parts in picker_sentences(text) for s in parts]
    outside = list(scorer(sentences))
    if mode == "replace":
        return outside[: len(sentences)]
    return [20 * x for x in combine_scores([sentence_score(s) for s in sentences], outside[: len(sentences)])]


# -- structured output

STRUCTURAL = _re(r"(?:\S+\.\w+:\d+:|[ \t]+[-•*]|[ \t]*\w[\w ./-]*:\s|(?:ERROR|FAIL|OK|PASS|SKIP|WARN|WARNING)\b)")
OUTCOME = _re(r"\b(?:duration|error|fail|failed|pass|passed|tests?|total|warn|warning)\b", re.I)
PLACE = _re(r"(\S+\.\w+):\d+:")


def _full_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if trim(x)]


def is_structured(text: str) -> bool:
    """Six lines or more, a line end every 80 characters, and more than half of the lines of a known form."""
    lines = _full_lines(text)
    return len(lines) >= 6 and text.count("\n") * 80 >= size(text) and 2 * sum(1 for x in lines if STRUCTURAL.match(x)) > len(lines)


def grep_paths(lines: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(m[1] for x in lines if (m := PLACE.match(x))))


def summarize_structured(text: str, budget: int) -> str:
    """Files and up to three outcome lines; where there are none, the first three lines and the last."""
    lines = _full_lines(text)
    paths = grep_paths(lines)
    parts = []
    if paths:
        parts.append("files: " + ", ".join(paths[:3]) + (f" +{len(paths) - 3} more" if len(paths) > 3 else ""))
    parts += list(dict.fromkeys(trim(x) for x in lines if OUTCOME.search(x)))[:3]
    if parts:
        return _fit(" | ".join(parts), budget)
    return _fit(" | ".join(map(trim, lines[:3])) + f" | ... | {trim(lines[-1])} ({len(lines)} lines)", budget)


# -- code and prose

FENCE = re.compile(r"^[ ]{0,3}```[^\n]*\n[\s\S]*?\n\s*```", re.M)


def split_code(text: str) -> tuple[list[str], list[str]]:
    """(prose pieces, fenced blocks); an unclosed fence is prose."""
    prose, code, last = [], [], 0
    for m in FENCE.finditer(text):
        prose.append(trim(text[last : m.start()]))
        code.append(m[0])
        last = m.end()
    prose.append(trim(text[last:]))
    return [p for p in prose if p], code


# -- budgets

SCALE = {"gentle": 1.0, "moderate": 0.5, "aggressive": 0.15}


def budget(length: int, entities: int | None = None, depth: str = "gentle") -> int:
    """Characters of a summary of a text; with ``entities``, dense texts get more."""
    scale = SCALE[depth]
    if entities is not None and length > 0:
        ratio = 0.3 * scale + min(entities / length * 500, 0.5) * scale - 0.15 * scale
        ratio = max(0.05, min(ratio, 0.45 * scale))
        return int(max(40 if depth == "aggressive" else 100, min(rounded(length * ratio), 800 * scale)))
    least, most = {"gentle": (200, 600), "moderate": (100, 300), "aggressive": (40, 120)}[depth]
    if length > 5000:
        most = rounded(most + most * math.log10(length / 5000) * 0.75)
    return max(least, min(rounded(length * 0.3 * scale), most))


# -- discourse units

BREAK = _re(
    r",\s*(?:and|but|or|so|yet|then|which|where|while|although|because|since|after|before|when|if|unless|as) |\s+(?:accordingly|additionally|consequently|furthermore|hence|however|instead|meanwhile|moreover|nevertheless|nonetheless|otherwise|therefore|thus)\s*[,.]?",
    re.I,
)
IN_TIME = _re(r"\b(?:after that|eventually|finally|first|later|next|subsequently|then)\b", re.I)
CAUSAL = _re(r"\b(?:as a result|because|hence|in order to|since|so that|therefore|thus)\b", re.I)
BACKWARD = _re(r"(?:it|that|the (?:output|response|result|value)|these|this|those)\b", re.I)
UNIT_SIZED = _re(r"\b\d+(?:\.\d+)?\s*(?:%|[gm]b|ms|retries?|seconds?)\b", re.I)
UNIT_STRESSED = _re(r"\b(?:always|critical|important|must|never|require)\b", re.I)
UNIT_FILLER = _re(r"(?:great|ok|right|sure|thanks|well|yes)\b", re.I)


@dataclass
class Unit:
    """A discourse unit; ``needs``: whether it leans on the unit before it."""

    text: str
    index: int
    depends_on: list[int] = field(default_factory=list)
    score: float = 0.0


def clauses(sentence: str) -> list[str]:
    parts, last = [], 0
    for m in BREAK.finditer(sentence):
        if len(trim(sentence[last : m.start()])) > 10:
            parts.append(sentence[last : m.start()])
        last = m.start()
    if trim(sentence[last:]):
        parts.append(sentence[last:])
    return parts or [sentence]


def segment_units(text: str) -> list[Unit]:
    units: list[Unit] = []
    for sentence in SENTENCE.findall(text) or [text]:
        for clause in clauses(trim(sentence)) if trim(sentence) else []:
            if size(trim(clause)) > 5:
                units.append(Unit(trim(clause), len(units)))
    for i, unit in enumerate(units[1:], 1):
        if BACKWARD.match(unit.text) or IN_TIME.search(unit.text) or CAUSAL.search(unit.text):
            unit.depends_on.append(i - 1)
    return units


def unit_score(text: str) -> float:
    score = 3.0 * sum(len(p.findall(text)) for p in (CAMEL, PASCAL, SNAKE)) + 2 * len(UNIT_SIZED.findall(text))
    return score + 4 * bool(UNIT_STRESSED.search(text)) - 5 * bool(UNIT_FILLER.match(trim(text))) + min(size(text) / 50, 2)


def score_units(units: list[Unit], scorer: Callable[[str], float] | None = None) -> list[Unit]:
    return [Unit(u.text, u.index, list(u.depends_on), (scorer or unit_score)(u.text)) for u in units]


def select_units(units: list[Unit], budget: int, depth: int = 2) -> list[Unit]:
    """The best units within the budget, each with those that it leans on, ``depth`` steps back."""
    chosen: set[int] = set()
    used = 0
    for unit in sorted(units, key=lambda u: -u.score):
        if used >= budget:
            break
        wanted, edge = {unit.index}, [unit.index]
        for _ in range(depth):
            edge = [d for i in edge for d in units[i].depends_on if d not in wanted]
            wanted.update(edge)
        room = sum(size(units[i].text) + 2 for i in wanted - chosen)
        if used + room <= budget:
            chosen |= wanted
            used += room
    return [u for u in units if u.index in chosen]


def summarize_units(text: str, budget: int, scorer: Callable[[str], float] | None = None) -> str:
    chosen = select_units(score_units(segment_units(text), scorer), budget)
    return " ".join(u.text for u in chosen) if chosen else trim(head(text, budget))


# -- token dropping


def whitespace_tokens(text: str) -> list[str]:
    return [t for t in re.split(f"[{BLANK}]+", text) if t]


def join_kept(tokens: Sequence[tuple[str, bool, float]], least: float = 0.5) -> str:
    """The text of the tokens that stay: those kept with confidence, and those dropped without."""
    text = " ".join(t for t, keep, sure in tokens if keep == (sure >= least))
    text = re.sub(r"\s+([.,;:!?\])}])", r"\1", text)
    return trim(re.sub(r"\s{2,}", " ", re.sub(r"([(\[{])\s+", r"\1", text)))


def pattern_classifier(patterns: Sequence[str], confidence: float = 0.9) -> Callable[[str], list[tuple[str, bool, float]]]:
    """A token classifier for tests: keeps what any pattern finds."""
    compiled = [_re(p) for p in patterns]
    return lambda text: [(t, any(p.search(t) for p in compiled), confidence) for t in whitespace_tokens(text)]


# -- entities

#: Capitalised words that open sentences and name nothing: parity data, in no order.
OPENERS = frozenset(
    """About After All Also Although An And Any As At Because Before Between But By Each Even Every Finally First For From Great He Her Here His How However If In Into It Its
    Just Last Let Many Most Much My Next No Not Note Now On Once Only Or Our Over Second See She Since So Some Still Sure Thanks That The Then There These They Third This Those
    To Under Unless Until We Well What When Where Which While Who Why With Yes Yet You Your""".split()
)
NOUNS = _re(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b")
VOWELLESS = PAIRS[1]
MEASURED = _re(r"\b\d+(?:\.\d+)?\s*(?:%|[kmgt]b|ms|percent|(?:attempt|byte|day|error|hour|instance|minute|node|replica|request|retrie|second|thread|user|worker)s?)\b", re.I)
PATHS = _re(r"(?:\.{1,2}/)?\b[\w./-]+\.\w{1,6}\b")
URLS = re.compile(rf"https?://[^{BLANK}]+")
VERSIONS = _re(r"\bv?\d+(?:\.\d+){1,2}\b")


def entities(text: str, cap: int | None = None) -> list[str]:
    """Distinct entities by kind and place; ``cap`` None takes 3 to 15 by length."""
    found = [x for x in NOUNS.findall(text) if x.split()[0] not in OPENERS]
    for pattern in (PASCAL, CAMEL, SNAKE):
        found += pattern.findall(text)
    found += [x.lower() for x in VOWELLESS.findall(text)]
    found += [trim(x) for x in MEASURED.findall(text)]
    found += [x for x in PATHS.findall(text) if len(x) > 4]
    found += URLS.findall(text) + VERSIONS.findall(text)
    return list(dict.fromkeys(found))[: cap if cap is not None else max(3, min(rounded(size(text) / 200), 15))]


def entity_stub(text: str) -> str:
    return ", ".join(entities(text, 10)) or trim(head(text, 40)) + "..."


def inline_definitions(names: Sequence[str], source: str) -> str:
    """For each of up to five names, the first sentence that has it; empty if none has."""
    sentences = SENTENCE.findall(source) or [source]
    out = []
    for name in names[:5]:
        first = next((s for s in sentences if name in s), None)
        if first is not None:
            out.append(head(trim(first), 77) + "..." if size(trim(first)) > 80 else trim(first))
    return f"[context: {' | '.join(out)}] " if out else ""
