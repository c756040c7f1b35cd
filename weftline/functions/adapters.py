"""Adapters for structured text: what of it must stay, what may be summarised, and how the two go together again.

An adapter is any object with the methods of ``FormatAdapter``; ``compress`` takes a sequence of them and uses the first
whose ``detect`` holds. They run on workers, so they must pickle. A text of which nothing may be summarised is rebuilt
with an empty summary.
"""

from __future__ import annotations

import re
from typing import Protocol

from weftline.functions.kernels import BLANK, LINE_ENDS, OUTCOME, PLACE, grep_paths, is_structured, size, split_code, trim


class FormatAdapter(Protocol):
    name: str

    def detect(self, text: str) -> bool: ...

    def preserved(self, text: str) -> list[str]: ...

    def compressible(self, text: str) -> list[str]: ...

    def rebuild(self, preserved: list[str], summary: str) -> str: ...


def is_prose(text: str) -> bool:
    """Six words or more, and 100 characters or more."""
    bare = trim(text)
    return size(bare) >= 100 and len(re.split(f"[{BLANK}]+", bare)) >= 6


class CodeAdapter:
    """Fenced blocks stay; the prose around them is summarised."""

    name = "code"

    def detect(self, text: str) -> bool:
        return "```" in text

    def preserved(self, text: str) -> list[str]:
        return split_code(text)[1]

    def compressible(self, text: str) -> list[str]:
        return split_code(text)[0]

    def rebuild(self, preserved: list[str], summary: str) -> str:
        return summary + "\n\n" + "\n\n".join(preserved)


class StructuredOutputAdapter:
    """Outcome lines and the paths of search hits stay; other lines are summarised."""

    name = "structured_output"

    def detect(self, text: str) -> bool:
        return is_structured(text)

    def _lines(self, text: str) -> list[str]:
        return [x for x in text.split("\n") if trim(x)]

    def preserved(self, text: str) -> list[str]:
        lines = self._lines(text)
        paths = grep_paths(lines)
        return [trim(x) for x in lines if OUTCOME.search(x)] + (["files: " + ", ".join(paths)] if paths else [])

    def compressible(self, text: str) -> list[str]:
        return [trim(x) for x in self._lines(text) if not OUTCOME.search(x) and not PLACE.match(x)]

    def rebuild(self, preserved: list[str], summary: str) -> str:
        return " | ".join([*preserved, summary] if summary else preserved)


class XmlAdapter:
    """Tags and short values stay; long text nodes and comments are summarised."""

    name = "xml"
    opening = re.compile(r"(?:\s*<\?xml[^>]*\?>)?\s*<[A-Za-z]")
    closing = re.compile(r"</[a-zA-Z]")
    node = re.compile(r">([^<]+)<")
    comment = re.compile(r"<!--(.*?)-->", re.S)

    def detect(self, text: str) -> bool:
        return bool(self.opening.match(text) and self.closing.search(text))

    def preserved(self, text: str) -> list[str]:
        return [trim(self.node.sub(lambda m: ">[…]<" if is_prose(m[1]) else m[0], text))]

    def compressible(self, text: str) -> list[str]:
        return [trim(x) for x in [*self.node.findall(text), *map(trim, self.comment.findall(text))] if is_prose(x)]

    def rebuild(self, preserved: list[str], summary: str) -> str:
        return "\n".join(preserved) + (f"\n<!-- {summary} -->" if summary else "")


class YamlAdapter:
    """Keys with short or atomic values stay; long values are summarised."""

    name = "yaml"
    key = re.compile(r"[ \t]*(\w[.\w-]*)\s*:\s*([^" + LINE_ENDS + "]*)", re.ASCII)
    plain = re.compile(r"~|null|false|true|[0-9][0-9_.,]*(?:e[-+]?[0-9]+)?", re.ASCII | re.I)

    def detect(self, text: str) -> bool:
        """Four lines or more besides comments, over 35 % of them with a key."""
        lines = [x for x in text.split("\n") if trim(x) and not trim(x).startswith("#")]
        return len(lines) >= 4 and sum(1 for x in lines if self.key.fullmatch(x)) > 0.35 * len(lines)

    def _long(self, line: str) -> re.Match[str] | None:
        found = self.key.fullmatch(line)
        if not found:
            return None
        value = trim(found[2])
        short = size(value) <= 60 or value.startswith(("&", "*")) or self.plain.fullmatch(value)
        return None if short else found

    def preserved(self, text: str) -> list[str]:
        return [x for x in text.split("\n") if not self._long(x)]

    def compressible(self, text: str) -> list[str]:
        return [f"{m[1]}: {trim(m[2])}" for m in map(self._long, text.split("\n")) if m]

    def rebuild(self, preserved: list[str], summary: str) -> str:
        return "\n".join([*preserved, f"# {summary}"] if summary else preserved)


class MarkdownAdapter:
    """Headings and tables stay; paragraphs are summarised."""

    name = "markdown"
    heading = re.compile(r"#{1,6}\s+\S")
    table = re.compile(r"\|.+\|")
    rule = re.compile(r"[-*_]{3,}\s*")

    def detect(self, text: str) -> bool:
        return size(text) >= 200 and sum(1 for x in text.split("\n") if self.heading.match(x)) >= 2

    def preserved(self, text: str) -> list[str]:
        out: list[str] = []
        rows: list[str] = []
        for line in [*text.split("\n"), ""]:
            if self.table.fullmatch(line) and not self.heading.match(line):
                rows.append(line)
                continue
            if rows:
                out.append("\n".join(rows))
                rows = []
            if self.heading.match(line):
                out.append(line)
        return out

    def compressible(self, text: str) -> list[str]:
        lines = [x for x in text.split("\n") if not (self.heading.match(x) or self.table.fullmatch(x) or self.rule.fullmatch(x))]
        return [p for p in map(trim, re.split(r"\n{2,}", "\n".join(lines))) if p]

    def rebuild(self, preserved: list[str], summary: str) -> str:
        return "\n\n".join([*preserved, summary] if summary else preserved)


BUILT_IN: tuple[FormatAdapter, ...] = (XmlAdapter(), YamlAdapter(), MarkdownAdapter(), StructuredOutputAdapter(), CodeAdapter())
