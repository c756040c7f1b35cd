"""Messages that a later correction supersedes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import entities as E
from weftline.functions.patterns import ascii_edges
from weftline.functions.units import utf16_length
from weftline.operators.dedup import compressed_before
from weftline.runtime import materialize, ship

#: Messages of a conversation that are compared in one task; those of a longer one are compared word by word in joins.
LONG = 4096
#: Shared words and pairs of messages that a task holds at once.
HELD = 4_000_000

#: The first that fires names the signal.
SIGNALS = {
    "explicit_correction": r"(?i)\<(?:correction|actually)[:.,]",
    "negation_directive": r"(?i)\<no[.,]?\s+(?:we should|that's|it should|it's|use)",
    "instead_directive": r"(?i)\<(?:rather|instead)[.,]?\s+(?:you|we|use|do)",
    "retraction": r"(?i)\<(?:ignore|disregard|scratch that)\>",
    "dont_directive": r"(?i)\<don'?t\s+(?:use|include|import|do|add)\>",
    "not_but_pattern": r"(?i)\<not\s+\w+[.,]?\s+(?:go with|use|but)\>",
    "wait_correction": r"(?i)\<wait[.,]\s",
    "sorry_correction": r"(?i)\<sorry[.,]\s+(?:the|that|I)",
    "self_correction": r"(?i)\<I was wrong\>",
    "rephrase": r"(?i)\<let me (?:clarify|rephrase|correct)\>",
}


def signal(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(ascii_edges(p)), F.lit(k)) for k, p in SIGNALS.items()])


def topic_words(text: Column) -> Column:
    """Distinct words of three letters or more, and identifiers, in lower case."""
    take = lambda t, p: F.regexp_extract_all(t, F.lit(ascii_edges(p)), F.lit(0))
    return F.array_distinct(F.concat(take(F.lower(text), r"\<[a-z]{3,}\>"), F.transform(E.identifiers(text), F.lower)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers from each start on, as many as its size, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def first_corrections(roles: pa.Array, corrects: pa.Array, words: pa.Array, threshold: float) -> pa.Array:
    """For conversations as lists of messages in order: (at, by, overlap) of each message that one after it replaces, by place."""
    sizes = pc.list_value_length(roles).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    conv = np.repeat(np.arange(len(sizes)), sizes)
    role = pc.dictionary_encode(roles.flatten().fill_null("")).indices.to_numpy(zero_copy_only=False)
    named = pc.not_equal(roles.flatten().fill_null(""), "").to_numpy(zero_copy_only=False)
    lists = words.flatten()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(conv)), length)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    # The messages that have a word of a conversation stand together, in order.
    order = np.lexsort((flat, conv[owner]))
    held, theirs = owner[order], flat[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (theirs[1:] != theirs[:-1]) | (conv[held][1:] != conv[held][:-1])
    begin = np.flatnonzero(fresh)
    term, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    term[order], place[order] = np.cumsum(fresh) - 1, np.arange(len(order))
    n = sizes[conv[held[begin]]]
    weight = np.where(n >= 3, np.log1p(n / np.diff(np.append(begin, len(order)))), 1.0)
    total = np.bincount(owner, weight[term], len(conv))
    earlier = place - begin[term]
    later = np.flatnonzero(corrects.flatten().to_numpy(zero_copy_only=False).astype(bool))
    width = later - starts[conv[later]]
    first_word = np.cumsum(length) - length
    work = np.cumsum(np.bincount(owner, earlier, len(conv))[later] + width)
    found: list[tuple[np.ndarray, ...]] = []
    low = 0
    while low < len(later):
        high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + HELD)))
        mine, wide = later[low:high], width[low:high]
        word = _ranges(first_word[mine], length[mine])
        cell = np.cumsum(wide) - wide - starts[conv[mine]]
        at = np.repeat(np.repeat(cell, length[mine]), earlier[word]) + held[_ranges(begin[term[word]], earlier[word])]
        common = np.bincount(at, np.repeat(weight[term[word]], earlier[word]), int(wide.sum()))
        by, before = np.repeat(mine, wide), _ranges(starts[conv[mine]], wide)
        some = np.flatnonzero(common > 0)
        by, before = by[some], before[some]
        overlap = np.round(2 * common[some] / (total[before] + total[by]), 12)
        crossed = (role[before] != role[by]) & named[before] & named[by]
        reached = np.flatnonzero(overlap >= np.where(crossed, threshold * 1.5, threshold))
        by, before, overlap = by[reached], before[reached], overlap[reached]
        ranked = np.lexsort((before, overlap, by))
        last = ranked[np.append(by[ranked][1:] != by[ranked][:-1], True)[: len(ranked)]]
        found.append((before[last], by[last], overlap[last]))
        low = high
    before, by, overlap = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ranked = np.lexsort((by, before))
    ranked = ranked[np.append(True, before[ranked][1:] != before[ranked][:-1])[: len(ranked)]]
    before, by, overlap = before[ranked], by[ranked], overlap[ranked]
    edges = np.append(0, np.cumsum(np.bincount(conv[before], minlength=len(sizes))))
    base = starts[conv[before]]
    values = pa.StructArray.from_arrays([pa.array(before - base, pa.int32()), pa.array(by - base, pa.int32()), pa.array(overlap)], ["at", "by", "overlap"])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def contradictions(messages: DataFrame, topic_threshold: float = 0.15, preserve: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, pos, superseded_by, superseded_by_id, overlap, signal) of every message that a correction replaces.

    Overlap is the Dice measure of the two messages' words, weighted by ln(1 + n / document frequency) in conversations of three
    eligible messages or more. A correction takes the earlier message with the highest overlap, the nearer one if tied;
    across roles the threshold is half as high again. An earlier message keeps its first correction.

    Only corrections look for partners. Words travel as hashes, and once: a conversation of up to LONG messages is compared
    in arrays; pairs of a longer one are added up word by word, without the messages' words beside them.
    """
    ship(messages.sparkSession)
    text = F.coalesce("content", F.lit(""))
    fine = (utf16_length(text) >= 50) & ~compressed_before(text) & ~F.coalesce(F.col("role"), F.lit("")).isin(*preserve)
    hashed = F.transform(topic_words(text), lambda x: F.xxhash64(x))
    slim = messages.where(fine).select("conv_id", "pos", "id", "role", signal(text).alias("signal"), hashed.alias("words"))
    # Only conversations with a correction go on.
    whole = Window.partitionBy("conv_id")
    slim = slim.withColumn("n", F.count("*").over(whole)).withColumn("any", F.count("signal").over(whole)).where("any > 0").drop("any")
    # Read more than once, so the texts are gone through and written once.
    slim = materialize(slim, "topics")
    return _compared(slim.where(F.col("n") <= LONG), topic_threshold).unionByName(_joined(slim.where(F.col("n") > LONG), topic_threshold))


def _compared(slim: DataFrame, topic_threshold: float) -> DataFrame:
    """Contradictions of conversations that a task can hold."""
    find = F.arrow_udf(lambda roles, corrects, words: first_corrections(roles, corrects, words, topic_threshold), "array<struct<at:int,by:int,overlap:double>>")
    convs = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "role", "signal", "words"))).alias("m"))
    of = lambda f: F.transform("m", f)
    convs = convs.withColumn("found", find(of(lambda x: x["role"]), of(lambda x: x["signal"].isNotNull()), of(lambda x: x["words"])))
    each = F.transform("found", lambda x: F.struct(F.get("m", x["at"])["pos"].alias("pos"), F.get("m", x["by"]).dropFields("words").alias("by"), x["overlap"].alias("overlap")))
    return convs.select("conv_id", F.explode(each).alias("x")).select("conv_id", "x.pos", F.col("x.by.pos").alias("superseded_by"), F.col("x.by.id").alias("superseded_by_id"), F.round("x.overlap", 6).alias("overlap"), F.col("x.by.signal").alias("signal"))


def _joined(slim: DataFrame, topic_threshold: float) -> DataFrame:
    """Contradictions of conversations of any length: the weights of shared words are summed up by pair."""
    each = slim.select("conv_id", "pos", "signal", "n", F.explode("words").alias("word"))
    weight = F.when(F.col("n") >= 3, F.log1p(F.col("n") / F.count("*").over(Window.partitionBy("conv_id", "word")))).otherwise(1.0)
    each = each.withColumn("weight", weight)
    totals = each.groupBy("conv_id", "pos").agg(F.sum("weight").alias("total"))
    weighed = slim.drop("words", "n").join(totals, ["conv_id", "pos"])
    search = each.where("signal is not null").select("conv_id", "word", F.col("pos").alias("later"))
    common = each.select("conv_id", "word", "pos", "weight").join(search, ["conv_id", "word"]).where("pos < later").groupBy("conv_id", "pos", "later").agg(F.sum("weight").alias("common"))
    later = weighed.where("signal is not null").select("conv_id", F.col("pos").alias("later"), F.col("id").alias("later_id"), F.col("role").alias("later_role"), "signal", F.col("total").alias("later_total"))
    pairs = common.join(weighed.select("conv_id", "pos", "role", "total"), ["conv_id", "pos"]).join(later, ["conv_id", "later"])
    scored = pairs.withColumn("overlap", F.round(2 * F.col("common") / (F.col("total") + F.col("later_total")), 12))
    crossed = F.coalesce((F.col("role") != F.col("later_role")) & (F.col("role") != "") & (F.col("later_role") != ""), F.lit(False))
    reached = scored.where(F.col("overlap") >= F.when(crossed, topic_threshold * 1.5).otherwise(topic_threshold))
    best = reached.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "later").orderBy(F.desc("overlap"), F.desc("pos")))).where("k = 1")
    first = best.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "pos").orderBy("later"))).where("k = 1")
    return first.select("conv_id", "pos", F.col("later").alias("superseded_by"), F.col("later_id").alias("superseded_by_id"), F.round("overlap", 6).alias("overlap"), "signal")
