"""Repeated messages of a conversation: exact copies, near copies, and the groups that near copies form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.units import js_trim, utf16_length
from weftline.operators.graph import components


def compressed_before(content: Column) -> Column:
    return content.startswith("[summary:") | content.startswith("[summary#") | content.startswith("[truncated")


def recency_start(recency_window: int | Column) -> Column:
    """First position of the recency window; needs nothing but a count over the conversation."""
    return F.greatest(F.lit(0), F.count(F.lit(1)).over(Window.partitionBy("conv_id")) - recency_window)


def _eligible(preserve: tuple[str, ...], min_chars: int) -> Column:
    content = F.coalesce("content", F.lit(""))
    return (utf16_length(content) >= min_chars) & ~F.coalesce(F.col("role"), F.lit("")).isin(*preserve) & (F.coalesce(F.size("tool_calls"), F.lit(0)) <= 0) & ~compressed_before(content)


def _kept(start: Column, over) -> Column:
    """The copy that stays: the first in the recency window, else the last."""
    recent = F.min(F.when((F.col("pos") >= start) & (start > 0), F.col("pos"))).over(over)
    return F.coalesce(recent, F.max("pos").over(over))


def exact_duplicates(messages: DataFrame, recency_window: int | Column = 4, preserve: tuple[str, ...] = ("system",), min_chars: int = 200) -> DataFrame:
    """(conv_id, pos, duplicate_of, duplicate_of_id, content_length) of every message that repeats another one.

    Texts become digests before anything is shuffled; copies meet by digest and length.
    """
    content, fine = F.coalesce("content", F.lit("")), _eligible(preserve, min_chars)
    window = recency_window if isinstance(recency_window, Column) else F.lit(recency_window)
    slim = messages.select("conv_id", "pos", "id", window.alias("window"), fine.alias("fine"), F.when(fine, F.sha2(content, 256)).alias("digest"), utf16_length(content).alias("content_length"))
    slim = slim.withColumn("start", recency_start(F.col("window"))).where("fine")
    same = Window.partitionBy("conv_id", "digest", "content_length")
    found = slim.withColumn("duplicate_of", _kept(F.col("start"), same))
    found = found.withColumn("duplicate_of_id", F.max(F.when(F.col("pos") == F.col("duplicate_of"), F.col("id"))).over(same))
    return found.where("duplicate_of <> pos").select("conv_id", "pos", "duplicate_of", "duplicate_of_id", "content_length")


# -- near copies


def _lined(messages: DataFrame, recency_window: int | Column, preserve: tuple[str, ...], min_chars: int) -> DataFrame:
    """Messages of two lines or more that aren't exact copies: (conv_id, pos, id, start, size, head, lines), lines as hashes."""
    content = F.coalesce("content", F.lit(""))
    window = recency_window if isinstance(recency_window, Column) else F.lit(recency_window)
    lines = F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.lower(js_trim(x))), lambda x: x != "")
    hashed = F.transform(lines, lambda x: F.xxhash64(x))
    slim = messages.select("conv_id", "pos", "id", window.alias("window"), _eligible(preserve, min_chars).alias("fine"), utf16_length(content).alias("size"), F.when(_eligible(preserve, min_chars), hashed).alias("lines"))
    slim = slim.withColumn("start", recency_start(F.col("window"))).where("fine and size(lines) >= 2")
    gone = exact_duplicates(messages, recency_window, preserve, min_chars).select("conv_id", "pos")
    # A line's occurrences are told apart by a running number, so that multisets become sets.
    each = slim.join(gone, ["conv_id", "pos"], "left_anti").select("conv_id", "pos", "id", "start", "size", F.slice("lines", 1, 5).alias("head"), F.posexplode("lines").alias("at", "line"))
    again = F.row_number().over(Window.partitionBy("conv_id", "pos", "line").orderBy("at"))
    tokens = each.withColumn("token", F.xxhash64("line", again))
    return tokens.groupBy("conv_id", "pos", "id", "start", "size", "head").agg(F.collect_list("token").alias("tokens"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets, as arrays without repeats."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _pairs(lined: DataFrame, threshold: float) -> DataFrame:
    """(conv_id, a, b, similarity), a < b, of messages that share three of their first five lines and most of all lines.

    Two sets with Jaccard ``threshold`` or more share one of each one's rarest lines, so many that the rest is too small:
    only those are joined, and a line that opens every message joins nothing.
    """
    tokens = lined.select("conv_id", "pos", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rare = tokens.withColumn("df", F.count("*").over(Window.partitionBy("conv_id", "token"))).where("df > 1")
    # Lines found once can't be shared: they count as the rarest of a message, ahead of all that are joined.
    shared = F.count("*").over(Window.partitionBy("conv_id", "pos"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "pos").orderBy("df", "token")) + F.col("n") - shared
    prefix = rare.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("conv_id", "pos", "token")
    met = prefix.alias("x").join(prefix.select("conv_id", "token", F.col("pos").alias("b")).alias("y"), ["conv_id", "token"]).where("pos < b").select("conv_id", F.col("pos").alias("a"), "b").distinct()
    left = lined.select("conv_id", F.col("pos").alias("a"), F.col("size").alias("size_a"), F.col("head").alias("head_a"), F.col("tokens").alias("tokens_a"))
    right = lined.select("conv_id", F.col("pos").alias("b"), F.col("size").alias("size_b"), F.col("head").alias("head_b"), F.col("tokens").alias("tokens_b"))
    # A first line that occurs twice counts twice with each of its partners.
    opened = F.aggregate("head_a", F.lit(0), lambda n, x: n + F.size(F.filter("head_b", lambda y: y == x)))
    both = met.join(left, ["conv_id", "a"]).join(right, ["conv_id", "b"]).where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * 0.7)
    return both.where(opened >= 3).select("conv_id", "a", "b", jaccard(F.col("tokens_a"), F.col("tokens_b")).alias("similarity")).where(F.col("similarity") >= threshold)


def near_pairs(messages: DataFrame, threshold: float = 0.85, recency_window: int | Column = 4, preserve: tuple[str, ...] = ("system",), min_chars: int = 200) -> DataFrame:
    """(conv_id, a, b, similarity), a < b. Similarity is the multiset Jaccard of trimmed lower-case lines; exact repeats are left out first."""
    return _pairs(_lined(messages, recency_window, preserve, min_chars), threshold).withColumn("similarity", F.round("similarity", 6))


def fuzzy_duplicates(messages: DataFrame, threshold: float = 0.85, recency_window: int | Column = 4, preserve: tuple[str, ...] = ("system",), min_chars: int = 200) -> DataFrame:
    """(conv_id, pos, duplicate_of, duplicate_of_id, content_length, similarity) of every message that stands for another in its group.

    Groups are the connected components of near pairs. Similarity is that to the message that stays, also where the two
    are linked by others only.
    """
    lined = _lined(messages, recency_window, preserve, min_chars)
    root = components(_pairs(lined, threshold).select("conv_id", "a", "b"))
    member = lined.join(root.withColumnRenamed("node", "pos"), ["conv_id", "pos"])
    group = Window.partitionBy("conv_id", "root")
    placed = member.withColumn("duplicate_of", _kept(F.col("start"), group))
    keep = placed.where("pos = duplicate_of").select("conv_id", "duplicate_of", F.col("id").alias("duplicate_of_id"), F.col("tokens").alias("kept"))
    return placed.where("pos <> duplicate_of").join(keep, ["conv_id", "duplicate_of"]).select("conv_id", "pos", "duplicate_of", "duplicate_of_id", F.col("size").alias("content_length"), F.round(jaccard(F.col("tokens"), F.col("kept")), 6).alias("similarity"))
