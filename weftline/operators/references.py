"""Operators that relate the messages of a conversation by what they name: importance and coreference.

All pair work goes through shared keys (an entity), never through a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import entities as E
from weftline.functions.patterns import ascii_edges

PLACES = r"\S+\.\w+:[0-9]+"
# Which phrases count is parity data.
DECIDED = r"(?i)\<(?:" + "|".join(["always", "decided? to", "do not", "don't", "instead", "must", "never", "require[ds]?", "should", r"the\s+(?:answer|approach|fix|solution)\s+is", r"use\s+\w+\s+(?:instead|rather)", r"we(?:'ll| will)\s+(?:implement|use|go with)"]) + r")\>"
CORRECTED = r"(?i)\<(?:" + "|".join(["actually", "correction", "disregard", "ignore (?:my|that|the previous)", "instead[.,]", r"no[.,]?\s+(?:it's|that's|the|use)", r"not\s+\w+[.,]?\s+(?:but|it's|use)", "scratch that", "sorry[.,]", "wait[.,]"]) + r")\b"
LIMITED = r"(?i)\<(?:" + "|".join("backward compat|backwards compat|blocker|boundary|breaking change|constraint|deadline|dependency|limitation|prerequisite|requirement".split("|")) + r")\>"
#: Positions that one mask of bits covers.
BITS = 63


def signals(text: Column) -> Column:
    """0 to 0.4 from decisions, corrections and constraints in a text, in hundredths."""
    part = lambda p, n: F.when(text.rlike(ascii_edges(p)), n).otherwise(0)
    return F.least(F.lit(40), part(DECIDED, 15) + part(CORRECTED, 25) + part(LIMITED, 10))


def linked_entities(text: Column) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(ascii_edges(p)), F.lit(0)) for p in (E.CAMEL, E.PASCAL, E.SNAKE, E.VOWELLESS, PLACES)])
    return F.array_distinct(F.transform(found, F.lower))


def importance(messages: DataFrame) -> DataFrame:
    """(conv_id, pos, refs, importance): later messages that share an entity, content signals, and place in the conversation.

    Where an entity occurs is kept as masks of 63 positions, so a message meets its later partners 63 at a time; the masks
    of all its entities are joined by "or" and their bits counted, so that a partner counts once.
    """
    text = F.coalesce("content", F.lit(""))
    each = messages.select("conv_id", "pos", F.explode(linked_entities(text)).alias("entity"))
    each = each.select("conv_id", "pos", F.xxhash64("entity").alias("entity"), F.floor(F.col("pos") / BITS).alias("at"), (F.col("pos") % BITS).cast("int").alias("bit"))
    masks = each.groupBy("conv_id", "entity", "at").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask")).withColumnRenamed("at", "there")
    met = each.join(masks, ["conv_id", "entity"]).where("there >= at")
    # In the message's own stretch only the bits above its own are later.
    above = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit") + 1))
    later = met.select("conv_id", "pos", "there", F.when(F.col("there") == F.col("at"), above).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    refs = later.groupBy("conv_id", "pos", "there").agg(F.bit_count(F.bit_or("mask")).alias("n")).groupBy("conv_id", "pos").agg(F.sum("n").alias("refs"))
    whole = Window.partitionBy("conv_id")
    scored = messages.select("conv_id", "pos", signals(text).alias("s")).join(refs, ["conv_id", "pos"], "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    most, n = F.max("refs").over(whole), F.count("*").over(whole)
    value = F.when(most > 0, F.col("refs") / most * 0.5).otherwise(0.0) + F.col("s") / 100 + F.col("pos") / F.greatest(n - 1, F.lit(1)) * 0.1
    return scored.select("conv_id", "pos", F.col("refs").cast("long").alias("refs"), F.round(F.least(F.lit(1.0), value), 6).alias("importance"))


def coreference(messages: DataFrame) -> DataFrame:
    """(conv_id, entity, defined_at, nth, referenced_at): identifiers with the message that has them first and those after it.

    ``nth`` is the identifier's place among those of its message.
    """
    each = messages.select("conv_id", "pos", F.posexplode(E.identifiers(F.coalesce("content", F.lit("")))).alias("nth", "entity"))
    placed = each.groupBy("conv_id", "entity").agg(F.sort_array(F.collect_set("pos")).alias("at"), F.min_by("nth", "pos").alias("nth")).where(F.size("at") > 1)
    return placed.select("conv_id", "entity", F.get("at", F.lit(0)).alias("defined_at"), "nth", F.slice("at", 2, F.size("at") - 1).alias("referenced_at"))


def orphaned(definitions: DataFrame, compressed: DataFrame, preserved: DataFrame) -> DataFrame:
    """Definitions in ``compressed`` (conv_id, pos) that a message of ``preserved`` refers to."""
    inside = definitions.join(compressed.select("conv_id", F.col("pos").alias("defined_at")), ["conv_id", "defined_at"], "left_semi")
    used = inside.select("conv_id", "entity", F.explode("referenced_at").alias("pos")).join(preserved.select("conv_id", "pos"), ["conv_id", "pos"], "left_semi")
    return inside.join(used.select("conv_id", "entity").distinct(), ["conv_id", "entity"], "left_semi")
