"""Operator 2: quality rules as a learned decision list.

Statistics of each document come from Spark expressions over its whole text. From labelled statistics, sequential
covering learns rules for low quality: a rule grows, one threshold condition at a time, on one part of the labelled rows by
information gain, is pruned on the other part by its net precision, and is kept while it is mostly right there; the rows that
it covers are taken out and the next one is learned. The list is emitted as one ordered conditional Spark expression, so
scoring is a narrow projection without Python and without a shuffle.

Defined results:
- a null, empty or blank text has all statistics 0; it matches rule 0, ``no text``, and has quality 0, label or not;
- a document that no rule covers has quality 1 and rule ``default``;
- no label at all, or labels of one kind only: only rule 0 and the default apply;
- rows with a null id are scored like any other; repeated rows each give a row; ties between conditions go to the first
  statistic in order and the smaller threshold; an empty table gives no rows; other columns are ignored (``score``) or
  passed through unchanged (``good``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.runtime import BROADCAST_LIMIT_BYTES

#: Statistics in order; each is a ratio or a length that means the same at any corpus size.
FEATURES = ["n_words", "word_length", "upper_share", "digit_share", "mark_share", "symbol_share", "letter_share", "distinct_words", "line_words", "repeated_lines", "end_share", "bar_share"]


#: Characters that are counted, as classes of a regular expression.
CLASSES = {
    "_upper": r"\p{Lu}",
    "_digits": "[0-9]",
    "_marks": r"[.,;:!?'\"()\-]",
    "_symbols": r"[#$%&*@^~_=+<>{}\[\]\\/|]",
    "_ends": "[.!?]",
    "_bars": r"\|",
}


@dataclass(frozen=True)
class QualityParams:
    """max_labelled bounds the labelled rows that the rules are learned from."""

    max_labelled: int = 20_000
    max_rules: int = 16
    max_conditions: int = 4
    thresholds: int = 64
    min_covered: int = 3
    #: A rule is kept when at least this share of what it covers, in both parts, is of low quality.
    precision: float = 0.9


@dataclass(frozen=True)
class Rule:
    """All conditions hold: (statistic, at least (True) or at most, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if up else '<='} {t:.6g}" for f, up, t in self.conditions)


# -- statistics


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), 6)


def _once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator, so that the optimiser doesn't copy their expressions into each of their uses."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with struct ``_s`` of the statistics added; texts are cut into words and lines once."""
    text = F.coalesce("text", F.lit(""))
    counted = {name: F.regexp_count(text, F.lit(what)) for name, what in CLASSES.items()}
    flat = _once(docs, {"_t": F.trim(F.regexp_replace(text, r"\s+", " "))})
    lines = F.split(F.trim(F.regexp_replace(text, r"\s*\n\s*", "\n"), F.lit(" \n")), "\n")
    cut = _once(flat, {"_w": F.split("_t", " "), "_l": lines, **counted})
    cut = _once(cut, {"_lines": F.size("_l"), "_words": F.when((F.size("_w") == 1) & (F.get("_w", F.lit(0)) == ""), 0).otherwise(F.size("_w")), "_dw": F.size(F.array_distinct("_w")), "_dl": F.size(F.array_distinct("_l")), "_n": F.length("_t") - F.size("_w") + 1})
    c = F.col
    values = {
        "n_words": c("_words").cast("double"),
        "word_length": _share(c("_n"), c("_words")),
        "upper_share": _share(c("_upper"), c("_n")),
        "digit_share": _share(c("_digits"), c("_n")),
        "mark_share": _share(c("_marks"), c("_n")),
        "symbol_share": _share(c("_symbols"), c("_n")),
        "letter_share": _share(c("_n") - c("_digits") - c("_marks") - c("_symbols"), c("_n")),
        "distinct_words": _share(c("_dw"), c("_words")),
        "line_words": _share(c("_words"), c("_lines")),
        "repeated_lines": _share(c("_lines") - c("_dl"), c("_lines")),
        "end_share": _share(c("_ends"), c("_words")),
        "bar_share": _share(c("_bars"), c("_words")),
    }
    done = _once(cut, {"_s": F.struct(*[values[f].alias(f) for f in FEATURES])})
    return done.select(*docs.columns, "_s")


# -- learning


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for f, up, t in rule.conditions:
        v = x[:, FEATURES.index(f)]
        inside &= v >= t if up else v <= t
    return inside


def _grow(x: np.ndarray, bad: np.ndarray, params: QualityParams) -> Rule:
    """Conditions are added by information gain until only low quality is covered."""
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(conditions) < params.max_conditions:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for k, f in enumerate(FEATURES):
            v, b = x[inside, k], bad[inside]
            values = np.unique(v)
            if len(values) < 2:
                continue
            middles = (values[1:] + values[:-1]) / 2
            if len(middles) > params.thresholds:
                middles = np.unique(np.quantile(v[b], np.linspace(0, 1, params.thresholds // 2)).tolist() + np.quantile(v[~b], np.linspace(0, 1, params.thresholds // 2)).tolist())
            for up in (True, False):
                vb, vg = np.sort(v[b]), np.sort(v[~b])
                cb = len(vb) - np.searchsorted(vb, middles, "left") if up else np.searchsorted(vb, middles, "right")
                cg = len(vg) - np.searchsorted(vg, middles, "left") if up else np.searchsorted(vg, middles, "right")
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cb >= params.min_covered, cb * (np.log2(cb / np.maximum(cb + cg, 1)) - base), -1)
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-12:
                    best = (float(gain[i]), (f, up, float(np.float32(middles[i]))))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside = _holds(Rule(tuple(conditions)), x)
    return Rule(tuple(conditions))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule with the best net precision on rows that it didn't grow on."""
    best, chosen = -2.0, rule
    for k in range(1, len(rule.conditions) + 1):
        short = Rule(rule.conditions[:k])
        inside = _holds(short, x)
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best + 1e-12:
            best, chosen = worth, short
    return chosen


def learn(x: np.ndarray, quality: np.ndarray, params: QualityParams = QualityParams()) -> list[Rule]:
    """Ordered rules for low quality from labelled statistics; rows are taken in turn for growing (2 of 3) and pruning."""
    bad, rules = quality == 0, []
    part = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < params.max_rules:
        g, p = left & ~part, left & part
        if (bad & g).sum() < params.min_covered or not (~bad & g).any():
            break
        rule = _grow(x[g], bad[g], params)
        if not rule.conditions:
            break
        rule = _prune(rule, x[p], bad[p]) if p.any() else rule
        inside = _holds(rule, x)
        fine = True
        for rows in (g, p):
            right, wrong = int((bad & inside & rows).sum()), int((~bad & inside & rows).sum())
            fine &= right + wrong == 0 or right / (right + wrong) >= params.precision
        if not fine or not (bad & inside & left).any():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def labelled(docs: DataFrame, labels: DataFrame, params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and quality of the labelled documents with the smallest id hashes, at most about ``max_labelled``."""
    labels = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    n = labels.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = labels.where(draw <= int(min(1.0, params.max_labelled / max(1, n)) * (1 << 30)))
    # About max_labelled ids are expected; they are counted before they are sent. Texts meet them before their statistics are made.
    side = F.broadcast(some) if some.count() * 16 <= BROADCAST_LIMIT_BYTES else some
    joined = docs.select("doc_id", "text").join(side, "doc_id")
    rows = statistics(joined).select("doc_id", "quality", F.col("_s.*")).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable")
    return rows[FEATURES].to_numpy(np.float64), rows["quality"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> list[Rule]:
    return learn(*labelled(docs, labels, params), params)


# -- scoring


def decision(rules: list[Rule], stats: str = "_s") -> Column:
    """The number of the first rule that holds; 0: no text; -1: the default."""
    chain = F.when(F.col(f"{stats}.n_words") == 0, F.lit(0))
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, up, t in rule.conditions:
            value = F.col(f"{stats}.{f}")
            test = test & ((value >= t) if up else (value <= t))
        chain = chain.when(test, F.lit(i))
    return chain.otherwise(F.lit(-1))


def score(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, quality, rule_no, rule, statistics...) of every row of ``docs``."""
    found = statistics(docs.select("doc_id", "text")).select("doc_id", "_s", decision(rules).alias("rule_no"))
    names = F.array(F.lit("default"), F.lit("no text"), *[F.lit(str(r)) for r in rules])
    return found.select("doc_id", F.when(F.col("rule_no") >= 0, 0).otherwise(1).alias("quality"), "rule_no", F.get(names, F.col("rule_no") + 1).alias("rule"), "_s.*")


def good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that no rule takes out, all columns unchanged."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", F.col(f"c{names.index('text')}"))
    return statistics(flat).where(decision(rules) < 0).select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
