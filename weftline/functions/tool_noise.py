"""Trimmers of tool output: directory listings, build steps, package managers, passing tests, echoes.

Each gives the text that stays; a text without the noise comes back as it is.
"""

from __future__ import annotations

import re

from weftline.functions.kernels import head, size, trim

TREE = re.compile(r"[│├└|\\/ ─]+")
NOISE_FOLDER = re.compile(r"node_modules|__pycache__|\.(?:cache|git|next|nuxt)/|(?:coverage|dist)/")
BUILD_STEP = re.compile(r"\[?\s*\d+\s*/\s*\d+\s*\]?\s+\S", re.ASCII)
PACKAGE_NOISE = re.compile(r"npm (?:http|notice|timing|verb|warn)|yarn (?:info|warn)|pnpm\s+(?:notice|warn)|[⠇⠋⠏⠙⠦⠧⠴⠸⠹⠼]+\s")
PACKAGE_RESULT = re.compile(r"(?:added|audited|changed|found|removed)\s+\d+", re.ASCII)
TEST_PASSED = re.compile(r"\s*[+✓✔]\s+.{3,}")
TEST_SUMMARY = re.compile(r"(?:Suites?|Test Suites?|Tests?|Time):\s+\d+", re.ASCII | re.I)
#: Runs of lines of one kind shorter than this stay.
RUN = 5
PASSED_LINES = 10
ECHO_CHARS = 200
PROBE_CHARS = 120


def _collapse(text: str, belongs, stub) -> str:
    """Runs of RUN lines or more that belong together become what ``stub`` makes of them."""
    out: list[str] = []
    run: list[str] = []
    for line in [*text.split("\n"), None]:
        if line is not None and belongs(line):
            run.append(line)
            continue
        out += stub(run) if len(run) >= RUN else run
        run = []
        if line is not None:
            out.append(line)
    return "\n".join(out)


def trim_directories(text: str) -> str:
    return _collapse(text, lambda x: TREE.match(x) and NOISE_FOLDER.search(x), lambda run: [f"[... {len(run)} directory entries omitted ...]"])


def trim_build_steps(text: str) -> str:
    return _collapse(text, BUILD_STEP.match, lambda run: [run[0], f"[... {len(run) - 2} build steps omitted ...]", run[-1]])


def trim_packages(text: str) -> str:
    lines = text.split("\n")
    kept = [x for x in lines if not PACKAGE_NOISE.match(x) or PACKAGE_RESULT.match(x)]
    return "\n".join(kept) if len(lines) - len(kept) >= 3 else text


def trim_passed_tests(text: str) -> str:
    lines = text.split("\n")
    kept = [x for x in lines if not TEST_PASSED.fullmatch(x)]
    passed = len(lines) - len(kept)
    if passed < PASSED_LINES:
        return text
    at = next((i for i, x in enumerate(kept) if TEST_SUMMARY.search(x)), len(kept))
    return "\n".join([*kept[:at], f"[... {passed} passing test lines omitted ...]", *kept[at:]])


def trim_verbose(text: str) -> str:
    return trim_passed_tests(trim_packages(trim_build_steps(trim_directories(text))))


def trim_echoes(text: str, context: str) -> str:
    """Blocks whose start is in ``context`` become stubs; both must have ECHO_CHARS or more."""
    if size(context) < ECHO_CHARS or size(text) < ECHO_CHARS:
        return text
    out, found = [], False
    for block in re.split(r"\n\n+", text):
        bare = trim(block)
        if size(bare) >= ECHO_CHARS and head(bare, PROBE_CHARS) in context:
            found = True
            block = f"[content from preceding turn omitted ({size(bare)} chars)]"
        out.append(block)
    return "\n\n".join(out) if found else text
