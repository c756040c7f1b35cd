"""Fitting conversations into a number of tokens, all of them at once.

``binary``: the largest recency window with which a conversation fits, by bisection; each round compresses the
conversations that are still open, each with a window of its own. Features of texts are computed once, before the first
round. ``tiered``: the window stays, and older messages are tightened, then stubbed, then cut. With depth ``auto`` the
conversations that don't fit go on to the next depth.

In each pass messages are changed in a fixed order until the rest fits. What a change saves doesn't depend on the others,
so the messages changed are those whose forerunners save less than is needed: a running sum, not a loop.
"""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import kernels as K
from weftline.functions.units import utf16_length
from weftline.operators.compress import Compressed, counted, key, originals, result_messages, units_of
from weftline.operators.decisions import features
from weftline.operators.emission import DASH, summary_id
from weftline.operators.options import CompressOptions
from weftline.operators.quality_metrics import quality
from weftline.operators.references import importance
from weftline.runtime import materialize

DEPTHS = ("gentle", "moderate", "aggressive")
LOW_QUALITY = 0.6
CUT = 512
TINY = 80
LITTLE = 3


def _after(x: Column, options: CompressOptions) -> Column:
    """Tokens of a unit once it is written."""
    return F.when(F.col("out").isNotNull(), options.token_counter(F.col("out")).cast("long")).otherwise(F.aggregate("m", F.lit(0).cast("long"), lambda a, y: a + y["tokens"]))


def _fits(units: DataFrame, options: CompressOptions) -> DataFrame:
    """(conv_id, tokens) after compression."""
    return units.groupBy("conv_id").agg(F.sum(_after(F.col("m"), options)).alias("tokens"))


def _untouched(featured: DataFrame) -> DataFrame:
    """Units of conversations that fit as they are."""
    none = F.lit(None).cast("string")
    m = F.array(
        F.struct(
            F.col("pos").cast("int").alias("pos"), "id", key().alias("key"), "role", "content", "tool_calls", "original", F.lit("fits").alias("reason"), F.col("_size").alias("size"), F.col("_tokens").alias("tokens"),
            none.alias("note"), none.alias("signal"), F.lit(None).cast("double").alias("near"), F.col("_size").alias("room"), F.lit(None).cast("int").alias("adapter"), none.alias("tag"), F.lit(None).cast("boolean").alias("asked"), none.alias("kind"),
        )
    )
    return featured.select("conv_id", F.col("pos").cast("int").alias("pos"), none.alias("kind"), m.alias("m"), none.alias("out"), F.lit("fits").alias("reason"), none.alias("summary_id"), F.lit(0).cast("long").alias("version"))


# -- tightening


def _rows(units: DataFrame, options: CompressOptions, windows: DataFrame, extra: Column | None = None) -> DataFrame:
    """The result's messages with their tokens, whether they are older than the window, and what is too much in their conversation."""
    rows = result_rows(units).join(windows.select("conv_id", F.col("window").alias("_window")), "conv_id")
    conv = Window.partitionBy("conv_id")
    rows = rows.withColumn("_now", options.token_counter(F.col("text")).cast("long"))
    rows = rows.withColumn("_total", F.sum("_now").over(conv)).withColumn("_k", F.row_number().over(conv.orderBy("pos")) - 1).withColumn("_count", F.count("*").over(conv))
    old = (F.col("_k") < F.col("_count") - F.col("_window")) & ~F.coalesce("role", F.lit("")).isin(*options.preserve)
    return rows.withColumn("_old", old).withColumn("_excess", F.col("_total") - options.token_budget)


def result_rows(units: DataFrame) -> DataFrame:
    """A row a message of the result, with the unit that it comes from as one column."""
    parts = F.when(F.col("out").isNotNull(), F.array("m")).otherwise(F.transform("m", lambda x: F.array(x)))
    each = units.select("conv_id", "kind", "out", "reason", "summary_id", "version", F.explode(parts).alias("m"))
    first = F.get("m", F.lit(0))
    return each.select("conv_id", first["pos"].alias("pos"), first["role"].alias("role"), F.coalesce("out", first["content"], F.lit("")).alias("text"), "kind", "out", "reason", "summary_id", "version", "m")


def _units(rows: DataFrame) -> DataFrame:
    """Rows as units again: what stays is a unit of its own."""
    return rows.select("conv_id", "pos", "kind", "m", "out", "reason", "summary_id", "version")


def _applied(rows: DataFrame, candidate: Column, new: Column, order: list[Column], options: CompressOptions, kind: str, reason: str) -> DataFrame:
    """Change candidates in order until the conversation fits; one that wouldn't get shorter is passed over."""
    rows = rows.withColumn("_new", F.when(candidate, new))
    rows = rows.withColumn("_saved", F.when(F.col("_new").isNotNull(), F.col("_now") - options.token_counter(F.col("_new")).cast("long")))
    before = F.sum(F.coalesce("_saved", F.lit(0))).over(Window.partitionBy("conv_id").orderBy(F.col("_new").isNull(), *order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_hit", F.col("_new").isNotNull() & (F.coalesce(before, F.lit(0)) < F.col("_excess")))
    prefix = options.summary_id_prefix
    name = F.arrow_udf(lambda ids: pa.array([None if x is None else summary_id(x, prefix) for x in ids.to_pylist()], pa.string()), "string")
    rows = rows.withColumn("_fresh", F.col("_hit") & F.col("out").isNull())
    fresh = F.col("_fresh")
    return rows.select(
        "conv_id",
        "pos",
        F.when(fresh, kind).otherwise(F.col("kind")).alias("kind"),
        "m",
        F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("out")).alias("out"),
        F.when(F.col("_hit"), reason).otherwise(F.col("reason")).alias("reason"),
        F.coalesce(name(F.when(fresh, F.transform("m", lambda x: x["key"]))), "summary_id").alias("summary_id"),
        F.lit(options.source_version).cast("long").alias("version"),
    )


def _tighter(texts: pa.Array, made: pa.Array) -> pa.Array:
    """Summaries at 0.4 of their length, other texts at 0.15; null where the result isn't shorter."""
    out = []
    for text, again in zip(texts.to_pylist(), made.to_pylist()):
        n = K.size(text or "")
        if text is None or (again and not text.startswith("[summary")):
            out.append(None)
            continue
        short = K.summarize(text, max(TINY, K.rounded(n * (0.4 if again else 0.15))))
        named = [] if again else K.entities(text)[:3]
        short = f"[summary: {short}{' | entities: ' + ', '.join(named) if named else ''}]"
        out.append(short if K.size(short) < n else None)
    return pa.array(out, pa.string())


def _worth(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else K.best_sentence_score(t) for t in texts.to_pylist()], pa.int32())


def tiered(units: DataFrame, options: CompressOptions, windows: DataFrame) -> DataFrame:
    """Units after tightening (2a) and stubbing (2b) older messages, uncompressed ones and larger ones first."""
    made = F.col("out").isNotNull() | F.get("m", F.lit(0))["original"].isNotNull()
    order = [made.cast("int"), F.desc("_now"), F.col("pos")]
    rows = _rows(units, options, windows)
    wanted = F.col("_old") & (utf16_length(F.col("text")) > TINY) & (F.col("_excess") > 0)
    new = F.arrow_udf(_tighter, "string")(F.when(wanted, F.col("text")), made)
    tight = materialize(_applied(rows, wanted, new, order, options, "prose", "tightened"), "tight")
    rows = _rows(tight, options, windows)
    wanted = F.col("_old") & (utf16_length(F.col("text")) > TINY) & (F.col("_excess") > 0)
    score = F.arrow_udf(_worth, "int")(F.when(wanted, F.col("text")))
    return _applied(rows, wanted & (score < LITTLE), F.lit("[message omitted]"), order, options, "prose", "stubbed")


def force_converge(units: DataFrame, options: CompressOptions, windows: DataFrame, messages: DataFrame) -> DataFrame:
    """Cut older messages of more than CUT characters, the least important and longest first, until the conversation fits.

    Importance is that of the message at the same position of the input.
    """
    rows = _rows(units, options, windows)
    if options.importance_scoring:
        rows = rows.join(importance(messages).select("conv_id", "pos", "importance"), ["conv_id", "pos"], "left")
        first = [F.coalesce("importance", F.lit(0.0))]
    else:
        first = []
    size = utf16_length(F.col("text"))
    wanted = F.col("_old") & (size > CUT) & (F.col("_excess") > 0)
    cut = F.arrow_udf(lambda t: pa.array([None if x is None else K.head(x, CUT) for x in t.to_pylist()], pa.string()), "string")(F.when(wanted, F.col("text")))
    new = F.concat(F.lit(f"[truncated {DASH} "), size.cast("string"), F.lit(" chars: "), cut, F.lit("]"))
    return _applied(rows, wanted, new, [*first, F.desc(size), F.col("pos")], options, "prose", "force_converge")


# -- fit


def _bisected(featured: DataFrame, options: CompressOptions) -> tuple[DataFrame, DataFrame]:
    """(units, (conv_id, window)): every conversation with the largest window that fits, or the least if none does."""
    state = materialize(featured.groupBy("conv_id").agg(F.lit(options.min_recency_window).alias("lo"), (F.count("*") - 1).cast("int").alias("hi")), "windows")
    while state.where("lo < hi").limit(1).count():
        # Halved upwards; only conversations that are still open are compressed.
        probe = state.where("lo < hi").select("conv_id", F.ceil((F.col("lo") + F.col("hi")) / 2).cast("int").alias("window"))
        got = _fits(units_of(featured.join(probe.select("conv_id"), "conv_id", "left_semi"), options, probe), options)
        moved = probe.join(got, "conv_id").select("conv_id", "window", (F.col("tokens") <= options.token_budget).alias("fits"))
        state = state.join(moved, "conv_id", "left").select("conv_id", F.when(F.col("fits"), F.col("window")).otherwise(F.col("lo")).alias("lo"), F.when(~F.col("fits"), F.col("window") - 1).otherwise(F.col("hi")).alias("hi"))
        state = materialize(state, "windows")
    windows = state.select("conv_id", F.col("lo").alias("window"))
    return units_of(featured, options, windows), windows


def _at_depth(featured: DataFrame, options: CompressOptions) -> tuple[DataFrame, DataFrame]:
    if options.budget_strategy == "tiered":
        windows = featured.select("conv_id").distinct().withColumn("window", F.lit(options.recency_window))
        units = tiered(materialize(units_of(featured, options), "units"), options, windows)
    else:
        units, windows = _bisected(featured, options)
    units = materialize(units, "units")
    if options.force_converge:
        units = materialize(force_converge(units, options, windows, featured), "units")
    return units, windows


def fit(messages: DataFrame, options: CompressOptions, prepass: DataFrame | None = None) -> Compressed:
    """Compress until ``token_budget`` is kept; ``Compressed.fit`` says for each conversation whether it is, and by which window.

    Conversations within the budget stay as they are, with a window of all their messages. With depth ``auto``, those that
    don't fit go on from gentle to moderate and aggressive, unless their quality is below LOW_QUALITY by then.
    """
    featured = materialize(features(messages, options), "features")
    sums = featured.groupBy("conv_id").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n"))
    fine = sums.where(F.col("tokens") <= options.token_budget)
    units = [_untouched(featured.join(fine.select("conv_id"), "conv_id", "left_semi"))]
    fits = [fine.select("conv_id", F.lit(True).alias("fits"), F.col("tokens").alias("token_count"), F.col("n").cast("int").alias("recency_window"))]
    rest = featured.join(fine.select("conv_id"), "conv_id", "left_anti")
    depths = DEPTHS if options.compression_depth == "auto" else (options.compression_depth,)
    for depth in depths:
        rest = materialize(rest, "rest")
        now = replace(options, compression_depth=depth)
        done, windows = _at_depth(rest, now)
        found = _fits(done, options).join(windows, "conv_id").select("conv_id", (F.col("tokens") <= options.token_budget).alias("fits"), F.col("tokens").alias("token_count"), F.col("window").cast("int").alias("recency_window"))
        if depth == depths[-1]:
            over = found.where(F.lit(False)).select("conv_id")
        else:
            poor = quality(originals(done), result_messages(done)).where(F.col("quality_score") < LOW_QUALITY).select("conv_id")
            squeezed = counted(done, options).where("messages_compressed + messages_deduped + messages_contradicted > 0").select("conv_id")
            stop = poor.join(squeezed, "conv_id", "left_semi")
            over = materialize(found.where(~F.col("fits")).select("conv_id").join(stop, "conv_id", "left_anti"), "over")
        units.append(done.join(over, "conv_id", "left_anti").select(*units[0].columns))
        fits.append(found.join(over, "conv_id", "left_anti"))
        rest = rest.join(over, "conv_id", "left_semi")
    whole, all_fits = units[0], fits[0]
    for u, f in zip(units[1:], fits[1:]):
        whole, all_fits = whole.unionByName(u), all_fits.unionByName(f)
    return Compressed(whole, options, prepass, all_fits)
