"""Queries over the message operators; ``weftline.plans.oracle`` has the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import content as C
from weftline.functions import kernels as K
from weftline.functions.entities import entities
from weftline.functions.units import djb2, js_trim, tokens, utf16_length
from weftline.operators import compress as X
from weftline.operators import quality_metrics as Q
from weftline.operators import references as R
from weftline.operators.cluster import clusters
from weftline.operators.contradiction import contradictions
from weftline.operators.decisions import annotated, decisions, features, ruled, whole
from weftline.operators.dedup import exact_duplicates, fuzzy_duplicates, near_pairs, recency_start
from weftline.operators.feedback import distillation_pairs
from weftline.operators.flow import flow_chains
from weftline.operators.options import CompressOptions
from weftline.operators.prepass import tool_prepass
from weftline.operators.restore import restore, restored
from weftline.runtime import materialize, scratch, ship
from weftline.sources.messages import from_conversations, from_documents, renumbered
from weftline.sources.store import load, publish

#: Every relation between messages at once.
ALL = CompressOptions(recency_window=2, fuzzy_dedup=True, importance_scoring=True, contradiction_detection=True, conversation_flow=True, semantic_clustering=True, coreference=True)
NO_CAP = 2**31 - 1


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table that comes in fewer pieces than there are cores (one small file) is dealt out; a large one isn't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def scripted(turns: DataFrame) -> DataFrame:
    """Four messages a turn, so that every operator has something to find: the text, a correction of it, a near copy, a copy."""
    t = turns.select("*", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
    content = (
        F.when(F.col("k") == 1, F.concat(F.lit("Actually, we should use the "), "role", F.lit("_store api, not the old one. "), "content"))
        .when(F.col("k") == 2, F.concat("content", F.lit("\nReviewed by fetchData on line "), F.col("pos").cast("string")))
        .otherwise(F.col("content"))
    )
    return t.select("conv_id", (F.col("pos") * 4 + F.col("k")).alias("pos"), F.concat_ws("-", "id", F.col("k").cast("string")).alias("id"), "role", content.alias("content"), "tool_calls")


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripted(_turns(spark, sf_dir))


# -- rows by themselves


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "pos", "id", "role", "content")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    n = tokens(F.col("content"))
    return t.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(n).alias("tokens"), F.max(n).alias("largest"))


def recency_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("start", recency_start(4))
    return t.where("pos >= start").select("conv_id", "pos", "id", "role")


def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("pos")
    t = _turns(spark, sf_dir).withColumn("fresh", F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1))
    t = t.withColumn("run", F.sum("fresh").over(order))
    return t.groupBy("conv_id", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.min("role").alias("role"), F.sum(utf16_length(F.col("content"))).alias("chars"))


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.col("text"), C.reasons(F.col("text")).alias("found"))
    tier, confidence = C.classified(F.col("text"), F.col("found"))
    return d.select("doc_id", tier.alias("tier"), F.round(confidence, 2).alias("confidence"), F.array_join("found", ",").alias("reasons"), F.coalesce(C.hard(F.col("found")), F.lit(False)).alias("hard"))


def entity_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", entities(F.col("text"), NO_CAP).alias("found")).select("doc_id", F.size("found").cast("long").alias("n"), F.array_join(F.sort_array("found"), "|").alias("entities"))


def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = js_trim(F.col("props"))
    valid = F.coalesce(props.rlike(r"^[\[{]") & F.try_parse_json(props).isNotNull(), F.lit(False))
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"))


def best_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.arrow_udf(lambda t: pa.array([K.best_sentence_score(x or "") for x in t.to_pylist()], pa.int64()), "long")
    return _script(spark, sf_dir).select("conv_id", "pos", score("content").alias("score"))


def summary_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    def depth(name: str):
        return F.arrow_udf(lambda n: pa.array([K.budget(x, None, name) for x in n.to_pylist()], pa.int64()), "long")

    d = _docs(spark, sf_dir).select("doc_id", utf16_length(F.col("text")).alias("n"))
    return d.select("doc_id", *[depth(name)("n").alias(name) for name in K.SCALE])


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", Q.structural_elements(F.col("html")).cast("long").alias("elements"))


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return t.select("id", djb2(F.col("id")).alias("id_hash"), djb2(F.col("content"), prefixed=True).alias("content_hash"))


# -- messages among others


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_script(spark, sf_dir))


def document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(from_documents(_docs(spark, sf_dir)))


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_script(spark, sf_dir))


def fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_duplicates(_script(spark, sf_dir))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.importance(_script(spark, sf_dir))


def coreference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.coreference(_script(spark, sf_dir)).select("conv_id", "entity", "defined_at", F.array_join("referenced_at", ",").alias("referenced_at"))


def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradictions(_script(spark, sf_dir)).select("conv_id", "pos", "superseded_by", "superseded_by_id", "overlap", "signal")


def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(_script(spark, sf_dir)).select("conv_id", "pos", "reason", "duplicate_of_id", "preserved")


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = CompressOptions(recency_window=2)
    return materialize(ruled(annotated(features(_script(spark, sf_dir), o), o), o), "ruled")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_chains(_ruled(spark, sf_dir)).select("conv_id", "first", F.array_join("members", ",").alias("members"), "accepted", "reason", "tag")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(_ruled(spark, sf_dir)).select("conv_id", "first", F.array_join("members", ",").alias("members"), "accepted", "reason", "tag")


def trimmed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of the script as tool messages, which echo the assistant."""
    s = _script(spark, sf_dir).withColumn("role", F.when(F.col("pos") % 4 == 3, "tool").otherwise(F.col("role")))
    return tool_prepass(whole(s))[0].select("conv_id", "pos", "id", "role", "content")


# -- compression


def compressed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(X.compress(_turns(spark, sf_dir)).messages)


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(X.compress(from_documents(_docs(spark, sf_dir))).messages)


def compressed_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(X.compress(_script(spark, sf_dir), ALL).messages)


def _shown(result: DataFrame) -> DataFrame:
    return result.select("conv_id", "pos", "id", "role", "content", "ids", F.col("original.summary_id").alias("summary_id"), "action", "reason", "input_chars", "output_chars")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.compress(_script(spark, sf_dir), ALL).trace


def compression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(X.compress(_turns(spark, sf_dir))).stats


def _kept(done: X.Compressed) -> X.Compressed:
    return X.Compressed(materialize(done.units, "units"), done.options, done.prepass, done.fit)


def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _kept(X.compress(_script(spark, sf_dir)))
    return Q.compressed_quality(done.messages, done.verbatim)


def message_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _kept(X.compress(_script(spark, sf_dir)))
    return Q.message_quality(done.messages, done.verbatim)


def distilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _kept(X.compress(_script(spark, sf_dir)))
    return distillation_pairs(done.messages, done.verbatim)


def _half(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A script and what a plain rule keeps of it: texts and their copies stay."""
    s = _script(spark, sf_dir)
    return s, s.where(F.col("pos") % 2 == 0)


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality(*_half(spark, sf_dir))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.retention(*_half(spark, sf_dir))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compress, publish, read what was published and restore; the SQL is the input itself."""
    at = scratch(spark, "store")
    publish(X.compress(_script(spark, sf_dir)), at)
    return restored(*load(spark, at)).select("conv_id", "pos", "id", "role", "content")


def round_trip_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compress what was compressed, and restore all the way."""
    at = scratch(spark, "store")
    publish(X.compress(_script(spark, sf_dir)), at)
    again = renumbered(load(spark, at)[0])
    # The second time summaries may be grouped like any message.
    loose = again.withColumn("content", F.concat(F.lit("Before: "), "content"))
    publish(X.compress(loose, CompressOptions(recency_window=0, dedup=False)), at)
    back = restore(*load(spark, at), recursive=True).messages
    return back.select("conv_id", "pos", "id", "role", F.when(F.col("content").startswith("Before: "), F.substring(F.col("content"), 9, NO_CAP)).otherwise(F.col("content")).alias("content"))


def fit_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = X.compress(_turns(spark, sf_dir), CompressOptions(token_budget=400, force_converge=True))
    return done.fit


def fit_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = X.compress(_turns(spark, sf_dir), CompressOptions(token_budget=400, budget_strategy="tiered", force_converge=True))
    return done.fit


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "compress_conversations": compressed_turns,
    "compress_documents": compressed,
    "compress_related": compressed_related,
    "compression_stats": compression_stats,
    "compression_quality": compression_quality,
    "message_quality": message_quality,
    "decision_trace": trace,
    "distillation_pairs": distilled,
    "round_trip": round_trip,
    "round_trip_twice": round_trip_twice,
    "fit_binary": fit_binary,
    "fit_tiered": fit_tiered,
    "messages": messages,
    "token_estimate": token_estimate,
    "recency_window": recency_window,
    "role_runs": role_runs,
    "classify": classify,
    "entities": entity_sets,
    "json_validity": json_validity,
    "best_sentence": best_sentence,
    "summary_budget": summary_budget,
    "structural_elements": structure,
    "text_hashes": text_hashes,
    "exact_duplicates": duplicates,
    "document_duplicates": document_duplicates,
    "fuzzy_pairs": fuzzy_pairs,
    "fuzzy_groups": fuzzy_groups,
    "importance": importance,
    "coreference": coreference,
    "contradictions": superseded,
    "decisions": decide,
    "flow_chains": chains,
    "clusters": clustered,
    "tool_prepass": trimmed_tools,
    "quality_measures": quality_measures,
    "retention": retention,
}
