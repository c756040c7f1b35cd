"""The compression pipeline over many conversations at once: decide, group, summarise, keep provenance, count.

``compress`` gives units: runs of messages that leave together, each with what it becomes. Messages, the store of
originals, the trace and the statistics are all read off them, so writing the units once (``store.publish``) is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import kernels as K
from weftline.functions.units import utf16_length
from weftline.operators.cluster import clusters
from weftline.operators.decisions import KEY, annotated, features, ruled, whole
from weftline.operators.emission import emitter
from weftline.operators.flow import flow_chains
from weftline.operators.options import CompressOptions
from weftline.operators.prepass import tool_prepass
from weftline.operators.quality_metrics import quality
from weftline.operators.references import coreference
from weftline.runtime import materialize
from weftline.sources.messages import ORIGINAL

ACTIONS = {"copy": "deduped", "near": "fuzzy_deduped", "superseded": "contradicted", "code": "code_split"}


@dataclass(frozen=True)
class Compressed:
    """``units`` is lazy; publish or materialise it before reading several of the tables below from it."""

    units: DataFrame
    options: CompressOptions
    #: (conv_id, verbose_trimmed, echo_trimmed, expired_stubbed, chars_removed), with ``tool_prepass``.
    prepass: DataFrame | None = None
    #: (conv_id, fits, token_count, recency_window), with a token budget.
    fit: DataFrame | None = None

    @property
    def messages(self) -> DataFrame:
        return result_messages(self.units)

    @property
    def verbatim(self) -> DataFrame:
        return verbatim(self.units)

    @property
    def trace(self) -> DataFrame:
        return trace(self.units)

    @property
    def stats(self) -> DataFrame:
        return statistics(self)


def key() -> Column:
    """What the store knows a message by: its id; a summary, which has the id of its first message, also needs its own."""
    return F.when(F.col("original.summary_id").isNotNull(), F.concat_ws(":", F.col("original.summary_id"), "id")).otherwise(F.col("id"))


def _grouped(df: DataFrame, options: CompressOptions) -> DataFrame:
    """Ruled messages in units: (conv_id, pos, kind, m), kind null for what stays."""
    chained = None
    if options.conversation_flow:
        chained = flow_chains(df)
    if options.semantic_clustering:
        found = clusters(df, options.cluster_threshold, chained)
        chained = found if chained is None else chained.unionByName(found)
    if chained is not None:
        member = chained.where("accepted").select("conv_id", F.col("first").alias("_first"), F.col("reason").alias("_chain"), F.col("tag").alias("_tag"), F.explode("members").alias("pos"))
        df = df.join(member, KEY, "left")
    else:
        df = df.withColumn("_first", F.lit(None).cast("int")).withColumn("_chain", F.lit(None).cast("string")).withColumn("_tag", F.lit(None).cast("string"))
    order = Window.partitionBy("conv_id").orderBy("pos")
    prose = F.when(F.col("_first").isNull() & (F.col("kind") == "prose"), F.struct("role"))
    joined = F.coalesce(F.lag(prose).over(order) == prose, F.lit(False)) | (prose.isNotNull() & F.lag(prose).over(order).isNotNull() & F.col("role").isNull() & F.lag("role").over(order).isNull())
    # The number of a run is the position of its first message.
    run = F.max(F.when(~F.col("_joined"), F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_joined", joined).withColumn("_run", run)
    fields = ["pos", "id", key().alias("key"), "role", "content", "tool_calls", "original", "reason", F.col("_size").alias("size"), F.col("_tokens").alias("tokens")]
    notes = [F.coalesce("_copy_of", "_near_of", "_later").alias("note"), F.coalesce("_chain", "_signal").alias("signal"), F.col("_near").alias("near"), F.coalesce("_copy_size", "_size").alias("room"), F.col("_said.adapter").alias("adapter"), F.col("_tag").alias("tag"), F.col("_said.asked").alias("asked")]
    kind = F.when(F.col("_first").isNotNull(), "chain").when(F.col("kind") != "kept", F.col("kind"))
    one = F.struct(*fields, *notes, kind.alias("kind"))
    return df.groupBy("conv_id", F.coalesce("_first", "_run").cast("int").alias("pos")).agg(F.sort_array(F.collect_list(one)).alias("m"))


def _written(units: DataFrame, options: CompressOptions) -> DataFrame:
    """Units with ``kind``, ``out`` (null: the messages stay), ``reason`` and ``summary_id``."""
    first = F.get("m", F.lit(0))
    kind = first["kind"]
    each = lambda f: F.when(kind.isNotNull(), F.transform("m", f))
    room = F.when(kind == "copy", first["room"]).otherwise(first["size"])
    done = emitter(options)(kind, each(lambda x: F.coalesce(x["content"], F.lit(""))), each(lambda x: x["key"]), first["note"], first["signal"], first["near"], room.cast("int"), first["adapter"], first["tag"])
    units = units.withColumn("_done", done)
    return units.select("conv_id", "pos", kind.alias("kind"), "m", F.col("_done.out").alias("out"), F.coalesce("_done.reason", first["reason"]).alias("reason"), F.col("_done.summary_id").alias("summary_id"), F.lit(options.source_version).cast("long").alias("version"))


def _inlined(units: DataFrame, messages: DataFrame) -> DataFrame:
    """Units with the sentences that define a name put before their text, where a message that stays uses the name."""
    member = units.select("conv_id", F.col("pos").alias("unit"), F.col("out").isNotNull().alias("gone"), F.col("kind").isin("prose", "code", "adapted", "chain").alias("summed"), F.explode("m").alias("x"))
    member = member.select("conv_id", "unit", "gone", F.max(F.col("gone") & F.col("summed")).over(Window.partitionBy("conv_id")).alias("any"), F.col("x.pos").alias("pos"), F.col("x.content").alias("content"))
    member = member.where("any").drop("any")
    names = coreference(messages)
    used = names.select("conv_id", "entity", F.explode("referenced_at").alias("pos")).join(member.where("not gone").select(*KEY), KEY, "left_semi").select("conv_id", "entity").distinct()
    lost = names.join(used, ["conv_id", "entity"]).select("conv_id", F.col("defined_at").alias("pos"), "nth", "entity")
    lost = lost.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("nth", "entity"))).alias("names"))

    def defined(names: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([K.inline_definitions(n, t or "") for n, t in zip(names.to_pylist(), texts.to_pylist())], pa.string())

    inline = F.arrow_udf(defined, "string")(F.transform("names", lambda x: x["entity"]), F.col("content"))
    heads = member.where("gone").join(lost, KEY).select("conv_id", "unit", "pos", inline.alias("head")).where("head <> ''")
    heads = heads.groupBy("conv_id", F.col("unit").alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "head")), asc=False), lambda x: x["head"]), "").alias("_head"))
    return units.join(heads, KEY, "left").withColumn("out", F.when(F.col("out").isNotNull() & (F.col("out") != ""), F.concat(F.coalesce("_head", F.lit("")), "out")).otherwise(F.col("out"))).drop("_head")


def units_of(featured: DataFrame, options: CompressOptions, windows: DataFrame | None = None) -> DataFrame:
    """Units of featured messages; ``windows``: recency windows of their own for conversations, and only these."""
    related = options.fuzzy_dedup or options.importance_scoring or options.contradiction_detection
    linked = options.conversation_flow or options.semantic_clustering
    # What relates messages reads the rows again and again: they are written once instead of worked out each time.
    if related and windows is None:
        featured = materialize(featured, "features")
    df = ruled(annotated(featured, options, windows), options)
    if linked:
        df = materialize(df, "ruled")
    if options.compression_threshold is not None:
        small = F.sum("_tokens").over(Window.partitionBy("conv_id")) < options.compression_threshold
        df = df.withColumn("_small", small).withColumn("reason", F.when(F.col("_small"), "below_threshold").otherwise(F.col("reason"))).withColumn("kind", F.when(F.col("_small"), "kept").otherwise(F.col("kind")))
    units = _written(_grouped(df, options), options)
    return _inlined(materialize(units, "units"), featured) if options.coreference else units


def compress(messages: DataFrame, options: CompressOptions = CompressOptions()) -> Compressed:
    """Compress every conversation of ``messages`` (conv_id, pos, id, role, content, tool_calls, maybe original).

    Positions are 0, 1, ... and ids are unique in a conversation. Null contents count as empty and stay; an empty table
    gives empty tables. With a token budget see ``budget.fit``.
    """
    trimmed = None
    if options.tool_prepass:
        messages, trimmed = tool_prepass(whole(messages))
    if options.token_budget is not None:
        from weftline.operators.budget import fit

        return fit(messages, options, trimmed)
    return Compressed(units_of(features(messages, options), options), options, trimmed)


# -- results


def _members(field: str) -> Column:
    return F.transform("m", lambda x: x[field])


def action() -> Column:
    """What happened to a unit's messages."""
    done = F.when(F.col("out").isNull(), "preserved")
    for kind, name in ACTIONS.items():
        done = done.when(F.col("kind") == kind, name)
    return done.otherwise("compressed")


def result_messages(units: DataFrame) -> DataFrame:
    """(conv_id, pos, id, role, content, tool_calls, original, ids, action, reason, input_chars, output_chars), a row a message of the result.

    A summary has the position, id, role and calls of its first message; ``original`` says what it stands for.
    """
    parents = F.array_compact(F.transform("m", lambda x: x["original"]["summary_id"]))
    made = F.struct(_members("key").alias("ids"), F.col("summary_id"), F.when(F.size(parents) > 0, parents).alias("parent_ids"), F.col("version")).cast(ORIGINAL)
    each = units.select("conv_id", "out", "reason", action().alias("action"), F.when(F.col("out").isNotNull(), made).alias("made"), F.explode(F.when(F.col("out").isNotNull(), F.array("m")).otherwise(F.transform("m", lambda x: F.array(x)))).alias("m"))
    first = F.get("m", F.lit(0))
    content = F.coalesce("out", first["content"])
    return each.select(
        "conv_id",
        first["pos"].alias("pos"),
        first["id"].alias("id"),
        first["role"].alias("role"),
        content.alias("content"),
        first["tool_calls"].alias("tool_calls"),
        F.coalesce("made", first["original"]).alias("original"),
        _members("id").alias("ids"),
        "action",
        "reason",
        F.aggregate("m", F.lit(0), lambda a, x: a + x["size"]).alias("input_chars"),
        utf16_length(content).alias("output_chars"),
    )


def verbatim(units: DataFrame) -> DataFrame:
    """(conv_id, key, id, pos, role, content, tool_calls, original) of every message that a unit replaced; unique by (conv_id, key)."""
    return units.where("out is not null").select("conv_id", F.explode("m").alias("x")).select("conv_id", "x.key", "x.id", "x.pos", "x.role", "x.content", "x.tool_calls", "x.original")


def trace(units: DataFrame) -> DataFrame:
    """(conv_id, message_index, message_id, action, reason, input_chars, output_chars), a row a message of the input."""
    shared = F.when(F.col("out").isNull(), F.col("x.size")).otherwise(F.floor(utf16_length(F.col("out")) / F.col("n") + 0.5).cast("int"))
    each = units.select("conv_id", "out", "kind", "reason", action().alias("action"), F.size("m").alias("n"), F.explode("m").alias("x"))
    entered = F.when(F.col("kind") == "copy", F.col("x.room")).otherwise(F.col("x.size"))
    return each.select("conv_id", F.col("x.pos").alias("message_index"), F.col("x.id").alias("message_id"), "action", "reason", entered.alias("input_chars"), shared.alias("output_chars"))


def counted(units: DataFrame, options: CompressOptions) -> DataFrame:
    """Counters, characters, tokens and ratios of each conversation; a ratio without any output is 1."""
    n, done, stays = F.size("m"), F.col("out").isNotNull(), F.col("out").isNull()
    count = lambda test: F.sum(F.when(test, n).otherwise(0)).cast("long")
    of = lambda name: F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x[name])
    after = F.when(done, options.token_counter(F.col("out")).cast("long")).otherwise(of("tokens"))
    chars = F.when(done, utf16_length(F.col("out"))).otherwise(of("size"))
    asked = F.size(F.filter("m", lambda x: F.coalesce(x["asked"], F.lit(False))))
    sums = units.groupBy("conv_id").agg(
        F.sum(n).alias("messages_in"),
        F.sum(F.when(done, 1).otherwise(n)).alias("messages_out"),
        count(done & F.col("kind").isin("prose", "code", "adapted", "chain")).alias("messages_compressed"),
        count(stays).alias("messages_preserved"),
        count(F.col("kind") == "copy").alias("messages_deduped"),
        count(F.col("kind") == "near").alias("messages_fuzzy_deduped"),
        count(done & (F.col("kind") == "superseded")).alias("messages_contradicted"),
        count(stays & F.col("reason").startswith("pattern:")).alias("messages_pattern_preserved"),
        F.sum(asked).alias("messages_llm_classified"),
        count(stays & F.col("reason").startswith("llm_preserved:")).alias("messages_llm_preserved"),
        count(stays & F.col("reason").startswith("importance:")).alias("messages_importance_preserved"),
        count(done & F.col("reason").startswith("relevance_dropped:")).alias("messages_relevance_dropped"),
        F.sum(of("size")).alias("input_chars"),
        F.sum(chars).cast("long").alias("output_chars"),
        F.sum(of("tokens")).alias("input_tokens"),
        F.sum(after).alias("output_tokens"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(1.0)
    return sums.withColumn("ratio", ratio("input_chars", "output_chars")).withColumn("token_ratio", ratio("input_tokens", "output_tokens"))


def originals(units: DataFrame) -> DataFrame:
    """The messages that the units were made of."""
    return units.select("conv_id", F.explode("m").alias("x")).select("conv_id", "x.pos", "x.id", "x.role", "x.content", "x.tool_calls", "x.original")


def statistics(done: Compressed) -> DataFrame:
    """``counted`` with the quality measures, null where nothing was compressed, and what the prepass and the budget add."""
    out = counted(done.units, done.options).withColumn("original_version", F.lit(done.options.source_version).cast("long"))
    measures = quality(originals(done.units), result_messages(done.units))
    out = out.join(measures, "conv_id", "left")
    changed = (F.col("messages_compressed") + F.col("messages_deduped") + F.col("messages_fuzzy_deduped") + F.col("messages_contradicted")) > 0
    for name in ("entity_retention", "structural_integrity", "reference_coherence", "quality_score"):
        out = out.withColumn(name, F.when(changed, F.col(name)))
    if done.prepass is not None:
        trimmed = done.prepass.select("conv_id", (F.col("verbose_trimmed") + F.col("echo_trimmed") + F.col("expired_stubbed")).alias("messages_tool_prepass_trimmed"), F.col("chars_removed").alias("chars_tool_prepass_removed"))
        out = out.join(trimmed, "conv_id", "left")
    return out if done.fit is None else out.join(done.fit, "conv_id", "left")
