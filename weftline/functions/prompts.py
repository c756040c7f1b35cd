"""Hooks for language models: prompts, the reading of their answers, and the functions made of both.

The caller brings ``ask``: a function from a prompt to a text. Nothing here opens a connection. The prompts say the same as
those that users of such tools know, in our own words; a caller with prompts of their own passes ``system``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from weftline.functions.kernels import size, trim

Ask = Callable[[str], str]
KEEP_EXACT = ("code references", "file paths", "names of functions and variables", "URLs", "API keys", "error messages", "numbers", "technical decisions")
UNREADABLE = {"decision": "compress", "confidence": 0.0, "reason": "unparseable"}


@dataclass(frozen=True)
class SummarizerOptions:
    max_response_tokens: int = 300
    system: str = ""
    mode: str = "normal"  # normal, aggressive, structured
    preserve_terms: tuple[str, ...] = ()


@dataclass(frozen=True)
class ClassifierOptions:
    max_response_tokens: int = 100
    system: str = ""
    always_preserve: tuple[str, ...] = ()
    always_compress: tuple[str, ...] = ()


def _headed(system: str, body: str) -> str:
    return f"{system}\n\n{body}" if system else body


def summary_prompt(text: str, options: SummarizerOptions) -> str:
    """``aggressive`` asks for bullets in half the tokens; ``structured`` for reasons, values and past failures."""
    terms = [*KEEP_EXACT, *(t for t in options.preserve_terms if t not in KEEP_EXACT)]
    if options.mode == "structured":
        body = (
            "Summarise this message for an agent that goes on working in a later session.\n\n"
            "Write only those of these sections that have content:\n"
            "### REASONING\nOne or two sentences: decisions, results and why they matter.\n"
            "### VARS\nA table | name | value | purpose | of values that are needed later; shorten long opaque ones to 12 characters and \"...\".\n"
            "### GUARDRAILS\nA bullet for each failure, with what to do instead.\n\n"
            f"Stay under {options.max_response_tokens} tokens. Keep technical names exactly. Add nothing else."
        )
    else:
        hard = options.mode == "aggressive"
        room = max(1, options.max_response_tokens // 2) if hard else options.max_response_tokens
        how = "as terse bullet points" if hard else "concisely"
        body = f"Summarise this message {how}, in under {room} tokens.\n\nKeep exactly: {', '.join(terms[:-1])} and {terms[-1]}. Leave out filler and repetition. Keep the technical register. Give the summary only."
    return _headed(options.system, f"{body}\n\nText:\n{text}")


def create_summarizer(ask: Ask, options: SummarizerOptions = SummarizerOptions()) -> Callable[[str], str]:
    return lambda text: ask(summary_prompt(text, options))


def create_escalating_summarizer(ask: Ask, options: SummarizerOptions = SummarizerOptions()) -> Callable[[str], str]:
    """Normal first; aggressive where that fails or isn't shorter. An error of the second is the caller's to handle."""

    def run(text: str) -> str:
        try:
            short = ask(summary_prompt(text, replace(options, mode="normal")))
            if isinstance(short, str) and 0 < size(short) < size(text):
                return short
        except Exception:  # the caller's own function; the second attempt follows
            pass
        return ask(summary_prompt(text, replace(options, mode="aggressive")))

    return run


def classifier_prompt(text: str, options: ClassifierOptions) -> str:
    extra = lambda items: "".join(f"\n- {t}" for t in items)
    body = (
        "Decide whether this message must be kept word for word or may be summarised.\n\n"
        "Keep: decisions and commitments; what loses its meaning in other words; exact terms and definitions." + extra(options.always_preserve) + "\n\n"
        "Summarise: discussion and explanation; filler; repetition." + extra(options.always_compress) + "\n\n"
        f'Answer in under {options.max_response_tokens} tokens with this JSON only:\n{{"decision": "preserve" or "compress", "confidence": 0.0 to 1.0, "reason": "one sentence"}}'
    )
    return _headed(options.system, f"{body}\n\nMessage:\n{text}")


def parse_verdict(answer: str) -> dict[str, Any] | None:
    """The verdict in an answer: the whole of it, else its first braces, else its first fenced block; None if there is none."""
    tries = [answer]
    if m := re.search(r"\{[^}]*\}", answer):
        tries.append(m[0])
    if m := re.search(r"```(?:json)?\s*\n?(.*?)\n?\s*```", answer, re.S):
        tries.append(m[1].strip())
    for t in tries:
        try:
            found = json.loads(t)
        except ValueError:
            continue
        if isinstance(found, dict) and found.get("decision") in ("preserve", "compress") and isinstance(found.get("confidence"), (int, float)) and not isinstance(found["confidence"], bool) and isinstance(found.get("reason"), str):
            return {"decision": found["decision"], "confidence": max(0.0, min(1.0, float(found["confidence"]))), "reason": found["reason"]}
    return None


def create_classifier(ask: Ask, options: ClassifierOptions = ClassifierOptions()) -> Callable[[str], Mapping[str, Any]]:
    return lambda text: parse_verdict(ask(classifier_prompt(text, options))) or dict(UNREADABLE)


def create_escalating_classifier(ask: Ask, heuristic: Callable[[str], Sequence[str]], options: ClassifierOptions = ClassifierOptions()) -> Callable[[str], Mapping[str, Any]]:
    """The model's verdict; where it fails or can't be read, hard reasons that ``heuristic`` finds preserve a text."""
    inner = create_classifier(ask, options)

    def run(text: str) -> Mapping[str, Any]:
        try:
            said = inner(text)
            if said["confidence"] > 0:
                return said
        except Exception:  # the caller's own function; the heuristic follows
            pass
        found = heuristic(text)
        if found:
            return {"decision": "preserve", "confidence": min(0.95, 0.7 + 0.05 * len(found)), "reason": "heuristic_t0"}
        return {"decision": "compress", "confidence": 0.65, "reason": "heuristic_fallback"}

    return run


def strip_fences(text: str) -> str:
    bare = trim(text)
    m = re.fullmatch(r"```[^\n]*\n(.*?)\n\s*```", bare, re.S)
    return trim(m[1]) if m else bare


def string_list(value: Any) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []
