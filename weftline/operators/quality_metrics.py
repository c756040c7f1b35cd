"""How much of a conversation its compressed form still holds.

``quality`` compares whole conversations; the other measures look at compressed messages and the originals that they
stand for, joined from the store. Shares are between 0 and 1, and 1 where there is nothing to lose.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.entities import NOUNS, entities, identifiers
from weftline.functions.patterns import ascii_edges
from weftline.functions.units import js_trim, utf16_length

#: Entities of a message that a conversation's set takes in.
LIMIT = 500
CODE_BLOCK = r"```\w*\n(?s:.*?)```"
# Which words count as verbs is parity data.
VERBS = (
    """add allow analyze applies apply are been begin being bring build call can change check come compress compresses configure connect consume contain convert could create
    define deploy detect did do does enable end ensure establish establishes execute find follow gave generate get give go goes got had handle has have help hold
    implement improve include increase is keep know load look made maintain make manage may mean measure might monitor move must need play prevent process processes
    provide publish publishes put read receive reduce replace represent require resolve return run save say see seem send set shall should show start stop store support
    take tell test think took track tries try turn use used validate want was were will work would write"""
).split()
VERB = r"(?i)\<(?:" + "|".join(sorted(w + ("s?" if w[-1] != "s" and len(w) > 2 else "") for w in VERBS)) + r")\>"


def structural_elements(text: Column) -> Column:
    """Pairs of code fences, lines with one opening bracket, and one for a table of two rows or more; rounded down."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    table = F.when(count(r"(?m)^\|.+\|$") >= 2, 1).otherwise(0)
    return F.floor(count(r"(?m)^ {0,3}`{3}") / 2 + count(r"(?m)^\s*[\[{]\s*$") + table)


def _named(messages: DataFrame, *extra: str) -> DataFrame:
    return messages.select("conv_id", *extra, F.explode(entities(F.coalesce("content", F.lit("")), LIMIT)).alias("entity"))


def three(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def quality(originals: DataFrame, compressed: DataFrame) -> DataFrame:
    """(conv_id, entity_retention, structural_integrity, reference_coherence, quality_score) from two message tables with ``id``.

    Entities are compared as sets of a conversation. An entity coheres if a message that had it is still there under its id.
    """
    before, after = _named(originals, "id"), _named(compressed).distinct()
    alive = compressed.select("conv_id", "id", F.lit(1).alias("alive")).distinct()
    sources = before.join(alive, ["conv_id", "id"], "left").groupBy("conv_id", "entity").agg(F.max(F.coalesce("alive", F.lit(0))).alias("alive"))
    held = sources.join(after.withColumn("hit", F.lit(1)), ["conv_id", "entity"], "left")
    shares = held.groupBy("conv_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("e"), F.avg(F.when(F.col("hit") == 1, F.col("alive"))).alias("r"))
    shape = lambda m, name: m.groupBy("conv_id").agg(F.sum(structural_elements(F.coalesce("content", F.lit("")))).alias(name))
    both = shape(originals, "_in").join(shape(compressed, "_out"), "conv_id", "left").join(shares, "conv_id", "left")
    integrity = F.when(F.col("_in") > 0, F.least(F.coalesce("_out", F.lit(0)) / F.col("_in"), F.lit(1.0))).otherwise(1.0)
    parts = both.select("conv_id", F.coalesce("e", F.lit(1.0)).alias("e"), integrity.alias("s"), F.coalesce("r", F.lit(1.0)).alias("r"))
    return parts.select(
        "conv_id",
        three(F.col("e")).alias("entity_retention"),
        three(F.col("s")).alias("structural_integrity"),
        three(F.col("r")).alias("reference_coherence"),
        three(F.least(F.col("e") * 0.4 + F.col("s") * 0.4 + F.col("r") * 0.2, F.lit(1.0))).alias("quality_score"),
    )


# -- compressed messages


def paired(messages: DataFrame, store: DataFrame) -> DataFrame:
    """(conv_id, pos, id, content, before, chars) of compressed messages: ``before`` are the originals' texts, in order, as far as the store has them."""
    wanted = messages.where("original is not null").select("conv_id", "pos", "id", F.coalesce("content", F.lit("")).alias("content"), F.posexplode("original.ids").alias("k", "source"))
    found = wanted.join(store.select("conv_id", F.col("key" if "key" in store.columns else "id").alias("source"), F.coalesce("content", F.lit("")).alias("text")), ["conv_id", "source"])
    each = found.groupBy("conv_id", "pos", "id", "content").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]).alias("texts"))
    return each.select("conv_id", "pos", "id", "content", F.array_join("texts", "\n").alias("before"), "texts", F.aggregate("texts", F.lit(0), lambda a, x: a + utf16_length(x)).alias("chars"))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(0))


def _take(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_edges(pattern)), F.lit(0))


#: Capitalised words that open sentences, for the plain names of the retention measures; parity data.
PLAIN_OPENERS = "An And As At But By For From Here How If In It On That The There This To What When Where With".split()


def plain_names(text: Column) -> Column:
    """Capitalised names, file paths and web addresses."""
    openers = F.array(*[F.lit(w) for w in PLAIN_OPENERS])
    nouns = F.filter(_take(text, NOUNS), lambda x: ~F.array_contains(openers, F.get(F.split(x, r"\s+"), F.lit(0))))
    return F.array_distinct(F.concat(nouns, _take(text, r"(?:/[\w.-]+){2,}"), _take(text, r"https?://\S+")))


def markers(text: Column) -> Column:
    """Lines that give a text its shape: fences, bullets, numbered items; each as often as it occurs."""
    return F.transform(F.concat(_take(text, r"(?m)^ {0,3}`{3}\w*$"), _take(text, r"(?m)^[ \t]*[-\x{2022}*]\s+.+$"), _take(text, r"(?m)^[ \t]*[0-9]+[.)]\s+.+$")), js_trim)


def _kept(found: Column, text: Column) -> Column:
    return F.size(F.filter(found, lambda x: F.contains(text, x)))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 6)).otherwise(1.0)


def retention(originals: DataFrame, compressed: DataFrame) -> DataFrame:
    """(conv_id, keyword_retention, entity_retention, structural_retention): shares of what the originals hold that the compressed text still contains."""
    join = lambda m, name: m.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\n").alias(name))
    both = join(originals, "a").join(join(compressed, "b"), "conv_id", "left").withColumn("b", F.coalesce("b", F.lit("")))
    kinds = {"keyword": identifiers(F.col("a")), "entity": plain_names(F.col("a")), "structural": markers(F.col("a"))}
    for name, found in kinds.items():
        both = both.withColumn(f"_{name}", found).withColumn(f"_{name}_n", F.size(f"_{name}")).withColumn(f"_{name}_k", _kept(F.col(f"_{name}"), F.col("b")))
    return both.select("conv_id", *[_share(f"_{k}_k", f"_{k}_n").alias(f"{k}_retention") for k in kinds])


def message_quality(messages: DataFrame, store: DataFrame) -> DataFrame:
    """(conv_id, id, action, input_chars, output_chars, local_ratio, entity_retention, code_blocks_intact) of compressed messages."""
    pairs = paired(messages, store).join(messages.select("conv_id", "pos", "action"), ["conv_id", "pos"])
    found, blocks = entities(F.col("before"), LIMIT), _blocks(F.col("before"))
    each = pairs.withColumn("_n", F.size(found)).withColumn("_k", _kept(found, F.col("content"))).withColumn("_in", utf16_length(F.col("before"))).withColumn("_out", utf16_length(F.col("content")))
    intact = F.size(F.array_except(blocks, _blocks(F.col("content")))) == 0
    ratio = F.when(F.col("_out") > 0, F.round(F.col("_in") / F.col("_out"), 6)).otherwise(F.col("_in").cast("double"))
    return each.select("conv_id", "id", "action", F.col("_in").alias("input_chars"), F.col("_out").alias("output_chars"), ratio.alias("local_ratio"), _share("_k", "_n").alias("entity_retention"), intact.alias("code_blocks_intact"))


def incoherent(content: Column) -> Column:
    """Issues of one compressed text: 1 if it says almost nothing; else one for a sentence without a verb and one for a repeated sentence."""
    said = F.array_join(F.transform(F.regexp_extract_all(content, F.lit(r"(?i)\[summary:\s*(.*?)\]"), F.lit(1)), lambda x: F.concat(x, F.lit(" "))), "")
    text = F.when(said != "", said).otherwise(js_trim(F.regexp_replace(content, CODE_BLOCK, "")))
    sentences = F.filter(F.transform(F.split(text, r"[.!?]+", -1), js_trim), lambda s: F.length(s) > 3)
    fragment = F.exists(sentences, lambda s: (F.length(s) > 15) & ~s.rlike(ascii_edges(VERB)))
    lowered = F.transform(sentences, F.lower)
    twice = F.size(F.array_distinct(lowered)) < F.size(lowered)
    return F.when(text == "", 0).when(F.length(js_trim(text)) < 10, 1).otherwise(fragment.cast("int") + twice.cast("int"))


def compressed_quality(messages: DataFrame, store: DataFrame) -> DataFrame:
    """One row a conversation with compressed messages: retention, code blocks, density, larger outputs, coherence, score.

    (conv_id, entity_retention, structural_retention, code_block_integrity, information_density, negative_compressions,
    coherence_issues, avg_entity_retention, min_entity_retention, compressed_quality_score)
    """
    pairs = paired(messages, store)
    named, shaped, blocks = plain_names(F.col("before")), markers(F.col("before")), _blocks(F.col("before"))
    each = pairs.select(
        "conv_id",
        F.size(named).alias("en"),
        _kept(named, F.col("content")).alias("ek"),
        F.size(shaped).alias("sn"),
        _kept(shaped, F.col("content")).alias("sk"),
        F.size(blocks).alias("bn"),
        F.size(F.filter(blocks, lambda b: F.array_contains(_blocks(F.col("content")), b))).alias("bk"),
        F.aggregate("texts", F.lit(0), lambda a, x: a + F.size(entities(x, LIMIT))).alias("in_named"),
        F.col("chars").alias("in_chars"),
        F.size(entities(F.col("content"), LIMIT)).alias("out_named"),
        utf16_length(F.col("content")).alias("out_chars"),
        incoherent(F.col("content")).alias("issues"),
        F.size(entities(F.col("before"), LIMIT)).alias("wn"),
        _kept(entities(F.col("before"), LIMIT), F.col("content")).alias("wk"),
    )
    share = F.when(F.col("wn") > 0, F.col("wk") / F.col("wn")).otherwise(1.0)
    sums = each.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("en", "ek", "sn", "sk", "bn", "bk", "in_named", "in_chars", "out_named", "out_chars")],
        F.count_if(F.col("out_chars") > F.col("in_chars")).alias("negative_compressions"),
        F.sum("issues").alias("coherence_issues"),
        F.round(F.avg(share), 6).alias("avg_entity_retention"),
        F.round(F.min(share), 6).alias("min_entity_retention"),
    )
    density = F.when((F.col("in_chars") > 0) & (F.col("out_chars") > 0) & (F.col("in_named") > 0), F.round((F.col("out_named") / F.col("out_chars")) / (F.col("in_named") / F.col("in_chars")), 6)).otherwise(1.0)
    ids = messages.where("original is not null").select("conv_id", F.explode("original.ids").alias("key")).distinct()
    score = quality(store.join(ids, ["conv_id", "key"], "left_semi"), messages.where("original is not null")).select("conv_id", F.col("quality_score").alias("compressed_quality_score"))
    return sums.select(
        "conv_id",
        _share("ek", "en").alias("entity_retention"),
        _share("sk", "sn").alias("structural_retention"),
        _share("bk", "bn").alias("code_block_integrity"),
        density.alias("information_density"),
        "negative_compressions",
        "coherence_issues",
        "avg_entity_retention",
        "min_entity_retention",
    ).join(score, "conv_id", "left")


# -- probes and tradeoffs


def probes(messages: DataFrame, wanted: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(conv_id, label, passed): whether any message of the conversation passes; a probe is a test of a content column."""
    text = F.coalesce("content", F.lit(""))
    tests = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(test(text), F.lit(False)).alias("hit")) for label, test in wanted.items()])
    return messages.select("conv_id", F.explode(tests).alias("x")).groupBy("conv_id", "x.label").agg(F.bool_or("x.hit").alias("passed"))


def contains(what: str) -> Callable[[Column], Column]:
    return lambda text: F.contains(text, F.lit(what))


def finds(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(ascii_edges(pattern))


def code_contains(what: str) -> Callable[[Column], Column]:
    return lambda text: F.exists(_blocks(text), lambda b: F.contains(b, F.lit(what)))


def at_least(chars: int) -> Callable[[Column], Column]:
    return lambda text: utf16_length(text) >= chars


def tradeoff_summary(points: DataFrame) -> DataFrame:
    """(conv_id, quality_at_2x, quality_at_3x, max_ratio_above_80) from (conv_id, recency_window, ratio, quality_score).

    Quality at a ratio is that of the nearest point, null if none is within one half; the first of equally near ones counts.
    """
    at = lambda t: F.min_by("quality_score", F.struct(F.abs(F.col("ratio") - t), F.col("recency_window")))
    near = lambda t: F.min(F.abs(F.col("ratio") - t)) < 0.5
    best = F.greatest(F.lit(1.0), F.coalesce(F.max(F.when(F.col("quality_score") >= 0.8, F.col("ratio"))), F.lit(1.0)))
    return points.groupBy("conv_id").agg(F.when(near(2), at(2)).alias("quality_at_2x"), F.when(near(3), at(3)).alias("quality_at_3x"), best.alias("max_ratio_above_80"))


def overhead_ratio(milliseconds: Column, tokens: Column, ms_a_token: float = 20.0) -> Column:
    """Time of compression beside that of reading the tokens by a model; 0 without tokens."""
    return F.when(tokens * ms_a_token > 0, milliseconds / (tokens * ms_a_token)).otherwise(0.0)


#: metric: (how far it may fall, how far it may rise); None: as far as it likes.
TOLERANCES: dict[str, tuple[float | None, float | None]] = {
    "avg_entity_retention": (0.05, None),
    "code_block_integrity": (0.0, None),
    "probe_pass_rate": (0.05, None),
    "coherence_issues": (None, 0.0),
    "negative_compressions": (None, 0.0),
    "max_ratio_above_80": (0.1, None),
}


def regressions(baseline: DataFrame, current: DataFrame, tolerances: Mapping[str, tuple[float | None, float | None]] = TOLERANCES, default: float = 0.0) -> DataFrame:
    """(bench, scenario, metric, expected, actual, status) of what got worse; both tables are (bench, scenario, metric, value).

    A metric without a tolerance of its own may move by ``default``. ``status`` is ``missing`` for what the current run lacks,
    ``new`` for what the baseline lacks, and ``changed``.
    """
    rows = [(m, a, b) for m, (a, b) in tolerances.items()]
    table = baseline.sparkSession.createDataFrame(rows, "metric string, fall double, rise double")
    keys = ["bench", "scenario", "metric"]
    both = baseline.withColumnRenamed("value", "expected").join(current.withColumnRenamed("value", "actual"), keys, "full").join(F.broadcast(table.withColumn("own", F.lit(True))), "metric", "left")
    fall, rise = F.when(F.col("own"), F.col("fall")).otherwise(default), F.when(F.col("own"), F.col("rise")).otherwise(default)
    worse = F.coalesce(F.col("expected") - F.col("actual") > fall + 1e-12, F.lit(False)) | F.coalesce(F.col("actual") - F.col("expected") > rise + 1e-12, F.lit(False))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "new").when(worse, "changed")
    return both.withColumn("status", status).where("status is not null").select(*keys, "expected", "actual", "status")


METRICS = "bench string, scenario string, metric string, value double"


def save_baseline(metrics: DataFrame, path: str) -> None:
    """Write (bench, scenario, metric, value) as JSON lines, in order, in the place of what was there."""
    metrics.select("bench", "scenario", "metric", F.col("value").cast("double").alias("value")).orderBy("bench", "scenario", "metric").coalesce(1).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def sweep(messages: DataFrame, windows: list[int], compress: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(conv_id, recency_window, ratio, quality_score) for each of the windows that a conversation is long enough for.

    ``compress`` gives (stats, messages) of a window. A conversation's points end with the first window at which nothing is
    saved.
    """
    sizes = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    points = None
    for w in sorted(windows):
        stats, _ = compress(messages, w)
        one = stats.select("conv_id", F.lit(w).alias("recency_window"), "ratio", F.coalesce("quality_score", F.lit(1.0)).alias("quality_score")).join(sizes.where(F.col("n") >= w), "conv_id").drop("n")
        points = one if points is None else points.unionByName(one)
    idle = F.sum(F.when(F.col("ratio") <= 1.001, 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("recency_window").rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_idle", F.coalesce(idle, F.lit(0))).where("_idle = 0").drop("_idle")
