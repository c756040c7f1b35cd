"""Chains of messages that belong together: question and answer, request and action, correction, acknowledgement.

A message starts a chain with one of the next three; a confirmation within two more joins it. Earlier chains claim their
messages first, so the outcome at a message depends on what the five before it claimed, and on nothing else. A
conversation is cut into stretches of ``STRETCH`` positions; what a stretch leaves claimed is worked out for each of the 32
states that the one before can leave, the states are then run through the stretches, and each stretch is read once more
from its own. So a conversation of any length is never in one task, and the chains equal those of one pass.
"""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.kernels import BLANK
from weftline.functions.patterns import ascii_edges
from weftline.functions.units import js_trim, utf16_length
from weftline.runtime import ship

STRETCH = 4096
REACH = 5
SNIPPET = 160
_BLANK = "[" + re.escape(BLANK) + "]"
QUESTION = r"\?(?:" + _BLANK + r"|\z)"
# Which words count is parity data.
REQUEST = r"(?i)\<(?:" + "|".join("I need|add|can you|change|could you|create|delete|fix|implement|make|modify|please|remove|update|would you".split("|")) + r")\>"
CONFIRMED = r"(?i)^(?:" + "|".join("approved|awesome|confirmed|done|great|lgtm|looks good|ok|okay|perfect|ship it|sounds good|thank you|thanks|yes".split("|")) + r")"
CORRECTED = r"(?i)^(?:" + "|".join(["I meant", "actually", "correction", "instead", "my bad", "no[,.]", "not that", "sorry", "wait"]) + r")"
ACTED = r"(?i)\<(?:" + "|".join(["added", "changed", "created", "deleted", "done", "fixed", "here'?s", "I've", "implemented", "modified", "removed", "updated"]) + r")\>"
ARROW = chr(0x2192)

CHAIN = "array<struct<first:int,members:array<int>,accepted:boolean,reason:string,tag:string>>"
CHAINS = pa.list_(pa.struct([("first", pa.int32()), ("members", pa.list_(pa.int32())), ("accepted", pa.bool_()), ("reason", pa.string()), ("tag", pa.string())]))


def _flags(df: DataFrame) -> DataFrame:
    """Narrow rows: position, role, tests as bits, and the first characters of the text on one line."""
    text = F.coalesce("content", F.lit(""))
    bare = js_trim(text)
    line = js_trim(F.regexp_replace(text, "\n", " "))
    able = (F.col("pos") < F.col("_start")) & ~F.col("_role") & ~F.col("_called") & (F.col("_size") >= 10) & ~text.startswith("[summary:") & ~text.startswith("[summary#") & ~text.contains("```")
    tests = [able, text.rlike(QUESTION), text.rlike(ascii_edges(REQUEST)), bare.rlike(CONFIRMED), bare.rlike(CORRECTED), text.rlike(ascii_edges(ACTED))]
    blocked = F.col("kind").isin("copy", "near", "code", "adapted") | F.col("_done") | F.col("_called") | F.col("_role")
    return df.select(
        "conv_id",
        "pos",
        F.coalesce("role", F.lit("")).alias("role"),
        *[F.coalesce(t, F.lit(False)).alias(n) for t, n in zip(tests, ("able", "asks", "requests", "confirms", "corrects", "acts"))],
        blocked.alias("blocked"),
        F.col("_size").alias("size"),
        F.substring(line, 1, SNIPPET).alias("line"),
        utf16_length(line).alias("line_size"),
    )


def _cut(line: str, size: int, most: int) -> str:
    return line[: most - 3] + "..." if size > most else line


def _summary(kind: str, rows: list) -> str:
    a, b = rows[0], rows[1]
    sure = len(rows) > 2
    if kind == "qa":
        return f"Q: {_cut(a.line, a.line_size, 80)} {ARROW} A: {_cut(b.line, b.line_size, 120)}" + " (confirmed)" * sure
    if kind == "request_action":
        return f"Request: {_cut(a.line, a.line_size, 80)} {ARROW} {_cut(b.line, b.line_size, 120)}" + f" {ARROW} confirmed" * sure
    if kind == "correction":
        return f"Correction: {_cut(b.line, b.line_size, 150)}"
    return f"{_cut(a.line, a.line_size, 150)} (acknowledged)"


def _kind(a, b) -> str | None:
    if a.role == "user" and b.role == "assistant":
        if a.requests and b.acts:
            return "request_action"
        if a.asks and not b.asks:
            return "qa"
    if (a.role == b.role or (a.role == "user" and b.role == "assistant")) and b.corrects:
        return "correction"
    if a.role != b.role and a.size > 200 and b.size < 100 and b.confirms:
        return "acknowledgment"
    return None


def chains_in(rows: list, low: int, high: int, claimed: int) -> tuple[list[tuple[str, list[int]]], int]:
    """(chains that start at positions low to high - 1, claims left on the REACH positions from high).

    ``rows``: those of the stretch and REACH more, by position; ``claimed``: bits of the first REACH positions.
    """
    at = {r.pos: r for r in rows}
    taken = {low + k for k in range(REACH) if claimed >> k & 1}
    free = lambda p: p in at and at[p].able and p not in taken
    found = []
    for i in range(low, high):
        if not free(i):
            continue
        for j in range(i + 1, i + 4):
            kind = _kind(at[i], at[j]) if free(j) else None
            if kind:
                members = [i, j]
                if kind in ("qa", "request_action"):
                    members += [k for k in (j + 1, j + 2) if free(k) and at[k].confirms][:1]
                taken.update(members)
                found.append((kind, members))
                break
    return found, sum(1 << k for k in range(REACH) if high + k in taken)


def flow_chains(df: DataFrame) -> DataFrame:
    """(conv_id, first, members, accepted, reason, tag) of all chains; one is accepted if none of its messages is blocked and its tag is shorter.

    ``df``: ruled messages (``decisions.ruled``).
    """
    ship(df.sparkSession)
    stretch = F.floor(F.col("pos") / STRETCH).cast("int")
    # The first positions of a stretch are also read at the end of the one before.
    both = F.when((F.col("pos") % STRETCH < REACH) & (stretch > 0), F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    cut = lambda df: gathered(_flags(df).withColumn("stretch", F.explode(both)))

    def after(low: int, items: list) -> list[int]:
        return [chains_in(items, low, low + STRETCH, s)[1] for s in range(1 << REACH)]

    # Only conversations of several stretches need states.
    long_ones = df.where(stretch > 0).select("conv_id").distinct()
    states = F.arrow_udf(lambda stretch, m: pa.array([after(k * STRETCH, x) for k, x in zip(stretch.to_pylist(), named(m))], pa.list_(pa.int32())), "array<int>")
    moved = cut(df.join(long_ones, "conv_id", "left_semi")).select("conv_id", "stretch", states("stretch", "m").alias("states"))
    run = moved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stretch", "states"))).alias("all"))
    step = lambda a, x: F.concat(a, F.array(F.get(x["states"], F.element_at(a, -1))))
    entered = run.select("conv_id", F.posexplode(F.aggregate("all", F.array(F.lit(0)), step)).alias("stretch", "state"))
    placed = cut(df).join(entered, ["conv_id", "stretch"], "left").withColumn("state", F.coalesce("state", F.lit(0)))

    def find(low: int, state: int, items: list) -> list[tuple]:
        at = {r.pos: r for r in items}
        out = []
        for kind, members in chains_in(items, low, low + STRETCH, state)[0]:
            mine = [at[p] for p in members]
            tag = f"[summary: {_summary(kind, mine)} ({len(mine)} messages, {kind})]"
            fine = not any(r.blocked for r in mine) and len(tag) < sum(r.size for r in mine)
            out.append((members[0], members, fine, f"flow:{kind}", tag))
        return out

    each = F.arrow_udf(lambda stretch, state, m: pa.array([find(k * STRETCH, s, x) for k, s, x in zip(stretch.to_pylist(), state.to_pylist(), named(m))], CHAINS), CHAIN)
    return placed.select("conv_id", F.explode(each("stretch", "state", "m")).alias("x")).select("conv_id", "x.*")


def gathered(rows: DataFrame) -> DataFrame:
    """(conv_id, stretch, m): the rows of a stretch in one, by position. A worker then reads many stretches at a time."""
    return rows.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("conv_id", "stretch")]))).alias("m"))


def named(lists: pa.Array) -> Iterator[list]:
    """Lists of structs as lists of named tuples."""
    flat = lists.flatten()
    make = namedtuple("Row", [flat.type.field(i).name for i in range(flat.type.num_fields)])._make
    rows = [make(x) for x in zip(*(column.to_pylist() for column in flat.flatten()))]
    at = 0
    for n in lists.value_lengths().to_pylist():
        yield rows[at : at + n]
        at += n
