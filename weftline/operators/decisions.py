"""What becomes of each message: features of its text, notes from other messages, and the first rule that applies."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.content import hard_reasons
from weftline.functions.patterns import ascii_edges
from weftline.functions.units import js_trim, utf16_length
from weftline.operators.contradiction import contradictions
from weftline.operators.dedup import compressed_before, exact_duplicates, fuzzy_duplicates
from weftline.operators.options import CompressOptions
from weftline.operators.references import importance
from weftline.runtime import ship
from weftline.sources.messages import ORIGINAL

FENCE = r"(?m)^ {0,3}`{3}[^\n]*\n(?s:.*?)\n\s*`{3}"
PROSE_BESIDE_CODE = 80
KEY = ["conv_id", "pos"]


def whole(messages: DataFrame) -> DataFrame:
    """The columns that the pipeline reads; ``original`` is null where a message was never compressed."""
    made = F.col("original") if "original" in messages.columns else F.lit(None).cast(ORIGINAL)
    return messages.select("conv_id", "pos", "id", "role", "content", "tool_calls", made.alias("original"))


def _asked(options: CompressOptions):
    """A worker's answers for texts that aren't null: the classifier's verdict, and the first adapter that detects."""
    classifier, adapters = options.classifier, options.adapters

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            said = classifier(t) if classifier else {}
            at = next((i for i, a in enumerate(adapters) if a.detect(t)), None)
            out.append({"keep": said["reason"] if said.get("decision") == "preserve" else None, "asked": classifier is not None, "adapter": at})
        return pa.array(out, pa.struct([("keep", pa.string()), ("asked", pa.bool_()), ("adapter", pa.int32())]))

    return F.arrow_udf(run, "keep string, asked boolean, adapter int")


def features(messages: DataFrame, options: CompressOptions) -> DataFrame:
    """``messages`` with what the rules need and no recency window changes.

    The detectors run only on texts that the cheap rules let through.
    """
    ship(messages.sparkSession)
    text = F.coalesce("content", F.lit(""))
    df = whole(messages).withColumn("_size", utf16_length(text)).withColumn("_tokens", options.token_counter(F.col("content")).cast("long"))
    large = F.lit(False) if options.observation_threshold is None else F.col("_tokens") > options.observation_threshold
    df = df.withColumn("_large", large)
    df = df.withColumn("_role", F.coalesce("role", F.lit("")).isin(*options.preserve)).withColumn("_called", F.coalesce(F.size("tool_calls"), F.lit(0)) > 0).withColumn("_done", compressed_before(text))
    open_ = ~F.col("_role") & ~F.col("_called") & ~F.col("_done") & (F.col("_large") | (F.col("_size") >= options.short_chars))
    fence = F.instr(text, "```") > 0
    prose = F.aggregate(F.split(text, FENCE, -1), F.lit(0), lambda a, x: a + utf16_length(js_trim(x)))
    df = df.withColumn("_open", open_).withColumn("_prose", F.when(F.col("_open") & fence, prose))
    plain = F.col("_open") & ~fence
    hard = F.array_join(hard_reasons(text), ",") if options.classifier_mode != "full" else F.lit("")
    df = df.withColumn("_hard", F.when(plain & ~F.col("_large"), hard).otherwise(""))
    label = F.coalesce(*[F.when(text.rlike(ascii_edges(p)), F.lit(name)) for p, name in options.preserve_patterns], F.lit(None).cast("string"))
    df = df.withColumn("_pattern", F.when(plain & (F.col("_hard") == ""), label))
    left = plain & (F.col("_hard") == "") & F.col("_pattern").isNull() & (text != "")
    json = js_trim(text).rlike(r"^[\[{]") & F.try_parse_json(js_trim(text)).isNotNull()
    df = df.withColumn("_json", F.when(left & ~F.col("_large"), json).otherwise(False))
    if options.classifier or options.adapters:
        return df.withColumn("_said", _asked(options)(F.when(left, text)))
    return df.withColumn("_said", F.lit(None).cast("struct<keep:string,asked:boolean,adapter:int>"))


def annotated(featured: DataFrame, options: CompressOptions, windows: DataFrame | None = None) -> DataFrame:
    """Featured messages with ``_window`` and ``_start``, and the notes that other messages give them.

    ``windows``: (conv_id, window) where conversations have windows of their own.
    """
    df = featured.join(windows.select("conv_id", F.col("window").cast("int").alias("_window")), "conv_id") if windows is not None else featured.withColumn("_window", F.lit(options.recency_window))
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    df = df.withColumn("_window", F.greatest("_window", F.lit(0))).withColumn("_n", n).withColumn("_start", F.greatest(F.lit(0), F.col("_n") - F.col("_window")))
    # All notes are made from the same rows, none from rows that already carry another's.
    base, window = df.select(*KEY, "id", "role", "content", "tool_calls", "_window"), F.col("_window")
    notes = []
    if options.dedup:
        notes.append(exact_duplicates(base, window, options.preserve).select(*KEY, F.col("duplicate_of_id").alias("_copy_of"), F.col("content_length").alias("_copy_size")))
    if options.fuzzy_dedup:
        notes.append(fuzzy_duplicates(base, options.fuzzy_threshold, window, options.preserve).select(*KEY, F.col("duplicate_of_id").alias("_near_of"), F.col("similarity").alias("_near")))
    if options.importance_scoring:
        notes.append(importance(base).select(*KEY, F.col("importance").alias("_importance")))
    if options.contradiction_detection:
        notes.append(contradictions(base, options.contradiction_topic_threshold, options.preserve).select(*KEY, F.col("superseded_by_id").alias("_later"), F.col("signal").alias("_signal")))
    for note in notes:
        df = df.join(note, KEY, "left")
    absent = {"_copy_of": "string", "_copy_size": "int", "_near_of": "string", "_near": "double", "_importance": "double", "_later": "string", "_signal": "string"}
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in absent.items() if c not in df.columns])


def two_places(x: Column) -> Column:
    return F.format_number(x, 2)


def ruled(df: DataFrame, options: CompressOptions) -> DataFrame:
    """Annotated messages with ``reason`` and ``kind``: kept, copy, near, superseded, code, adapted or prose."""
    large, said = F.col("_large"), F.col("_said")
    named = lambda head, c: F.concat(F.lit(head), c)
    important = (F.col("_importance") >= options.importance_threshold) & ~large
    names = F.array(*[F.lit(a.name) for a in options.adapters]) if options.adapters else F.array(F.lit(""))
    reason = (
        F.when(F.col("_role"), "preserved_role")
        .when(~large & (F.col("_window") > 0) & (F.col("pos") >= F.col("_start")), "recency_window")
        .when(F.col("_called"), "tool_calls")
        .when(~large & (F.col("_size") < options.short_chars), "short_content")
        .when(F.col("_done"), "already_compressed")
        .when(important, named("importance:", two_places(F.col("_importance"))))
        .when(F.col("_copy_of").isNotNull(), "exact_duplicate")
        .when(F.col("_near_of").isNotNull(), "fuzzy_duplicate")
        .when(F.col("_later").isNotNull(), named("contradicted:", F.col("_signal")))
        .when(F.col("_prose") >= PROSE_BESIDE_CODE, "code_split")
        .when(F.col("_prose").isNotNull(), "code_fence_no_prose")
        .when(F.col("_hard") != "", named("hard_t0:", F.col("_hard")))
        .when(F.col("_pattern").isNotNull(), named("pattern:", F.col("_pattern")))
        .when(said["keep"].isNotNull(), named("llm_preserved:", said["keep"]))
        .when(F.col("_json"), "json_structure")
        .when(said["adapter"].isNotNull(), named("adapter:", F.get(names, said["adapter"])))
        .otherwise("compressible_prose")
    )
    kinds = {"exact_duplicate": "copy", "fuzzy_duplicate": "near", "code_split": "code", "compressible_prose": "prose"}
    kind = F.when(F.col("reason").startswith("contradicted:"), "superseded").when(F.col("reason").startswith("adapter:"), "adapted")
    for name, short in kinds.items():
        kind = kind.when(F.col("reason") == name, short)
    return df.withColumn("reason", reason).withColumn("kind", kind.otherwise("kept"))


def decisions(messages: DataFrame, options: CompressOptions = CompressOptions()) -> DataFrame:
    """``messages`` with ``reason``, ``preserved`` and ``duplicate_of_id``: the first rule that applies to each."""
    df = ruled(annotated(features(messages, options), options), options)
    return df.select(*whole(messages).columns, "reason", F.coalesce("_copy_of", "_near_of").alias("duplicate_of_id"), (F.col("kind") == "kept").alias("preserved"))
