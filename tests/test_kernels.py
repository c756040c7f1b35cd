"""Row-local kernels: sentences, budgets, discourse units, structured output, adapters, tool noise, prompts."""

import json

import pytest

from weftline.functions import adapters as A
from weftline.functions import kernels as K
from weftline.functions import prompts as P
from weftline.functions import tool_noise as N
from weftline.operators import feedback as FB
from weftline.operators.emission import summary_id

PROSE = "The retry worker waits before it sends another request to the queue service. It then reports what it found to the log. "


def test_lengths_are_utf16_units():
    assert K.size("a\U0001f600") == 3 and K.head("a\U0001f600b", 2) == "a" and K.head("a\U0001f600b", 3) == "a\U0001f600" and K.head("abc", 0) == ""
    assert K.trim("  x﻿") == "x" and K.rounded(2.5) == 3 and K.rounded(-0.5) == 0


def test_sentence_scores():
    assert K.sentence_score("fetchData") == 3 and K.sentence_score("FetchData user_id") == 6 and K.sentence_score("it must stop") == 4
    assert K.sentence_score("thus it ends") == 3 and K.sentence_score("30 seconds") == 2 and K.sentence_score("npm") == 2 and K.sentence_score("FAIL") == 3
    assert K.sentence_score("lib/a.ts:42: x") == 2 and K.sentence_score("a " * 20) == 2 and K.sentence_score("a " * 19) == 0 and K.sentence_score("Great, a") == -10
    # Words of letters without ASCII vowels count; accented letters are no word characters.
    assert K.sentence_score("été") == 0
    assert K.best_sentence_score("Ok. It must stop.") == 4 and K.best_sentence_score("no end mark fetchData") == 3 - 10
    assert K.split_sentences("One. Two! ") == ["One.", "Two!"] and K.split_sentences("  ") == [] and K.split_sentences("none") == ["none"]


def test_summary_stays_in_its_budget():
    text = "Great. " + PROSE * 10 + "\n\nNote that fetchData must never fail in 30 seconds. Ok."
    out = K.summarize(text, 200)
    assert K.size(out) <= 200 and "fetchData" in out and "Great" not in out
    assert K.summarize("", 50) == "" and K.summarize("a" * 300, 50).endswith("...") and len(K.summarize("a" * 300, 50)) == 50
    # Repeated sentences are taken once, and reading order is kept.
    assert K.summarize("It must go. It must go. We never stop.", 400) == "It must go. ... We never stop."
    assert K.summarize("First one here. Second one here.", 16, [0.0, 9.0]) == "Second one here."


@pytest.mark.parametrize("n, depth, entities, want", [(100, "gentle", None, 200), (1000, "gentle", None, 300), (5000, "gentle", None, 600), (10000, "gentle", None, 735), (1000, "moderate", None, 150), (1000, "aggressive", None, 45), (4000, "aggressive", None, 120), (1000, "moderate", 0, 100), (1000, "moderate", 10, 225), (4000, "aggressive", 4, 120)])
def test_budgets(n, depth, entities, want):
    # The last: 4000 characters at 0.0675, but no more than 120 at this depth.
    assert K.budget(n, entities, depth) == want


def test_outside_scores():
    assert K.normalize_scores([]) == [] and K.normalize_scores([2, 2]) == [0.5, 0.5] and K.normalize_scores([1, 3, 2]) == [0, 1, 0.5]
    assert K.combine_scores([0, 10], [1, 0]) == [0.6, 0.4]
    with pytest.raises(ValueError):
        K.combine_scores([1], [1, 2])
    assert K.entropy_scores("A b.\n\nc d", lambda s: [1.0 * len(x) for x in s], "replace") == [4.0, 3.0]
    assert K.entropy_scores("A b. It must c.", lambda s: [1.0, 0.0]) == [12.0, 8.0]


def test_structured_output():
    text = "\n".join(["src/a.ts:1: x", "src/b.ts:2: y", "src/c.ts:3: z", "src/d.ts:4: w", "PASS 3", "Tests: 5 passed", "Total 5"])
    assert K.is_structured(text) and not K.is_structured("\n".join(["plain words here"] * 9)) and not K.is_structured("PASS\n" * 5)
    assert K.summarize_structured(text, 400) == "files: src/a.ts, src/b.ts, src/c.ts +1 more | PASS 3 | Tests: 5 passed | Total 5"
    assert K.summarize_structured("a: 1\nb: 2\nc: 3\nd: 4\ne: 5", 400) == "a: 1 | b: 2 | c: 3 | ... | e: 5 (5 lines)"


def test_discourse_units():
    units = K.segment_units("The parser reads the file, and the loader checks it. This result is kept. Then it ends because fetchData failed.")
    assert [u.text for u in units][:2] == ["The parser reads the file", ", and the loader checks it."]
    assert units[2].depends_on == [1] and units[-1].depends_on == [len(units) - 2]
    chosen = K.select_units(K.score_units(units, lambda t: 9.0 if "fetchData" in t else 0.0), 100)
    # The best unit brings those that it leans on, two steps back.
    assert [u.index for u in chosen] == [1, 2, 3] and chosen[-1].text.endswith("failed.")
    assert K.summarize_units("", 10) == "" and K.segment_units("tiny") == []


def test_token_dropping():
    kept = K.join_kept([("The", True, 0.9), ("old", False, 0.9), ("cat", True, 0.4), ("sat", False, 0.2), (".", True, 0.9), ("(", True, 1), ("x", True, 1), (")", True, 1)])
    assert kept == "The sat. (x)"
    assert K.pattern_classifier(["^k"])("keep drop") == [("keep", True, 0.9), ("drop", False, 0.9)] and K.whitespace_tokens(" a \n b ") == ["a", "b"]


def test_entities_and_definitions():
    got = K.entities("The PaymentService calls fetchData and user_id on npm in Berlin, 30 seconds, src/a.ts v1.2.3", 500)
    assert {"PaymentService", "fetchData", "user_id", "npm", "Berlin", "30 seconds", "src/a.ts", "v1.2.3"} <= set(got) and "The" not in got
    assert K.entity_stub("no names at all here") == "no names at all here..." and K.entities("x" * 100 + " aB cD eF gH", None)[:3] == K.entities("x" * 100 + " aB cD eF gH", 3)
    assert K.inline_definitions(["fetchData", "nope"], "Intro. Here fetchData reads it. End.") == "[context: Here fetchData reads it.] " and K.inline_definitions([], "x") == ""


def test_code_split():
    prose, code = K.split_code("Before it.\n```py\nx = 1\n```\nAfter it.\n```\nunclosed")
    assert prose == ["Before it.", "After it.\n```\nunclosed"] and code == ["```py\nx = 1\n```"]


def test_summary_ids():
    assert summary_id(["b", "a"], "s_") == summary_id(["a", "b"], "s_") != summary_id(["a"], "s_")
    h = 5381
    for c in "m1":
        h = (h * 33 + ord(c)) % 2**32
    assert int(summary_id(["m1"], "")[0:], 36) == h


def test_adapters():
    long = "this value is a long piece of prose that says a lot about nothing in particular and goes on and on for long. " * 2
    xml = A.XmlAdapter()
    doc = f"<?xml version='1'?><a><v>1.0</v><d>{long}</d><!-- {long} --></a>"
    assert xml.detect(doc) and not xml.detect("<!DOCTYPE html><p>x</p>") and "<v>1.0</v>" in xml.preserved(doc)[0] and len(xml.compressible(doc)) == 2
    assert xml.rebuild(["<a/>"], "s") == "<a/>\n<!-- s -->" and xml.rebuild(["<a/>"], "") == "<a/>"
    yaml = A.YamlAdapter()
    doc = f"name: x\nversion: 1.0\nabout: {long}\nitems:\n  - a\n"
    assert yaml.detect(doc) and not yaml.detect("a\nb\nc\nd: e") and yaml.compressible(doc) == ["about: " + long.strip()] and "about" not in "".join(yaml.preserved(doc))
    md = A.MarkdownAdapter()
    doc = f"# One\n\n{long}\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Two\n\n---\n\n{long}\n"
    assert md.detect(doc) and md.preserved(doc) == ["# One", "| a | b |\n|---|---|\n| 1 | 2 |", "## Two"] and md.compressible(doc) == [long.strip()] * 2
    code = A.CodeAdapter()
    assert code.detect("```") and code.rebuild(["```\nx\n```"], "s") == "s\n\n```\nx\n```"
    out = A.StructuredOutputAdapter()
    text = "src/a.ts:1: x\n" * 6 + "Tests: 2 passed\nnote: y"
    assert out.detect(text) and out.preserved(text) == ["Tests: 2 passed", "files: src/a.ts"] and out.compressible(text) == ["note: y"]


def test_tool_noise():
    tree = "\n".join(["top"] + [f"├── node_modules/p{i}" for i in range(6)] + ["end"])
    assert N.trim_directories(tree) == "top\n[... 6 directory entries omitted ...]\nend" and N.trim_directories("├── node_modules/a") == "├── node_modules/a"
    steps = "\n".join(f"[{i}/7] build x" for i in range(1, 8))
    assert N.trim_build_steps(steps) == "[1/7] build x\n[... 5 build steps omitted ...]\n[7/7] build x"
    noise = "npm warn a\nnpm warn b\nnpm notice c\nadded 3 packages"
    assert N.trim_packages(noise) == "added 3 packages" and N.trim_packages("npm warn a\nx") == "npm warn a\nx"
    tests = "\n".join([f"  ✓ works well {i}" for i in range(10)] + ["Tests: 10 passed"])
    assert N.trim_passed_tests(tests) == "[... 10 passing test lines omitted ...]\nTests: 10 passed"
    block = "an echoed block of text that is long enough " * 6
    assert N.trim_echoes(f"head\n\n{block}\n\ntail", "x" * 200 + block) == f"head\n\n[content from preceding turn omitted ({len(block.strip())} chars)]\n\ntail"
    assert N.trim_echoes(block, "short") == block and N.trim_echoes(block, "y" * 300) == block


def test_model_hooks():
    asked = []
    summarizer = P.create_summarizer(lambda p: asked.append(p) or "short", P.SummarizerOptions(max_response_tokens=80, system="Be brief.", preserve_terms=("ticket ids",)))
    assert summarizer("text") == "short" and asked[0].startswith("Be brief.\n\n") and "80 tokens" in asked[0] and "and ticket ids" in asked[0]
    tries = iter(["longer than the text itself", "x"])
    assert P.create_escalating_summarizer(lambda p: next(tries))("some text") == "x"
    assert "REASONING" in P.summary_prompt("t", P.SummarizerOptions(mode="structured")) and "150 tokens" in P.summary_prompt("t", P.SummarizerOptions(mode="aggressive"))
    good = {"decision": "preserve", "confidence": 3, "reason": "r"}
    for answer in (json.dumps(good), f"So: {json.dumps(good)} ok", f"```json\n{json.dumps(good)}\n```"):
        assert P.parse_verdict(answer) == {"decision": "preserve", "confidence": 1.0, "reason": "r"}
    assert P.parse_verdict("nothing") is None and P.create_classifier(lambda p: "?")("x")["reason"] == "unparseable"
    escalating = P.create_escalating_classifier(lambda p: "?", lambda t: ["code_fence"] if "```" in t else [])
    assert escalating("```")["reason"] == "heuristic_t0" and escalating("x")["decision"] == "compress"
    assert P.strip_fences("```\nx\n```") == "x" and P.string_list(["a", 1]) == ["a"] and P.string_list("a") == []


def test_feedback():
    said = json.dumps({"lostPatterns": ["p"], "suggestedTerms": ["T", 4], "guidelines": ["g"]})
    box = FB.FeedbackCollector(lambda p: said)
    assert box.analyze() == FB.Feedback() and box.analyze_over_preservation() == FB.OverPreservation()
    box.add(["long"], ["short"], False, "lost it")
    found = box.analyze()
    assert found == FB.Feedback(("p",), ("T",), ("g",)) and "### Error: lost it" in FB.contrastive_prompt(box.pairs)
    options = FB.refine_summarizer(P.SummarizerOptions(system="s", preserve_terms=("A",)), found)
    assert options.preserve_terms == ("A", "T") and options.system == "s\n\n- g"
    assert FB.tighten_summarizer(options, FB.OverPreservation((), ("A",), ())).preserve_terms == ("T",)
    several = FB.refine_candidates(lambda p: json.dumps([{"preserveTerms": ["x"]}, {"guidelines": ["y"]}, {}]), P.SummarizerOptions(), found, 2)
    assert [(o.preserve_terms, o.system) for o in several] == [(("x",), ""), ((), "- y")]
    with pytest.raises(ValueError):
        FB.refine_candidates(lambda p: "{}", P.SummarizerOptions(), found)
