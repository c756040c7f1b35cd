"""Bringing originals back: one level or all the way down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import discard, scratch
from weftline.sources.messages import ORIGINAL

#: Rounds after the first that ``recursive`` may take.
MAX_DEPTH = 10
COLUMNS = ["conv_id", "id", "role", "content", "tool_calls", "original"]


@dataclass(frozen=True)
class Restored:
    """``messages`` has (conv_id, pos, id, role, content, tool_calls, original); ``missing`` the ids that the store lacks, by message."""

    messages: DataFrame
    missing: DataFrame
    expanded: int
    passed: int


def _once(messages: DataFrame, store: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(messages with their originals in their place, ids not found). ``messages`` has ``path``, by which it is ordered.

    Originals have the positions that the store knows, so that those of a chain with others in between come back among them.
    """
    made = F.coalesce(F.size(F.col("original.ids")), F.lit(0)) > 0
    wanted = messages.where(made).select("conv_id", F.col("path").alias("parent"), F.posexplode("original.ids").alias("k", "key"))
    known_as = F.col("key" if "key" in store.columns else "id")
    place = F.col("pos").cast("int") if "pos" in store.columns else F.lit(None).cast("int")
    kept = store.select("conv_id", known_as.alias("key"), F.struct("id", "role", "content", "tool_calls", "original", place.alias("place")).alias("found"))
    looked = wanted.join(kept, ["conv_id", "key"], "left")
    # Positions of the first round are on the axis of the messages, but not those of earlier publications, which have none.
    above = F.when(F.col("found.place").isNotNull(), F.slice("parent", F.lit(1), F.size("parent") - 1)).otherwise(F.col("parent")) if depth == 0 else F.col("parent")
    path = F.concat(above, F.array(F.coalesce("found.place", "k")))
    back = looked.where("found is not null").select("conv_id", path.alias("path"), "found.id", "found.role", "found.content", "found.tool_calls", "found.original", "parent")
    # A message of which nothing is found stays as it is.
    some = back.select("conv_id", F.col("parent").alias("path")).distinct()
    stays = messages.where(~made).unionByName(messages.where(made).join(some, ["conv_id", "path"], "left_anti").select(*messages.columns))
    return back.unionByName(stays.withColumn("parent", F.lit(None).cast("array<int>"))), looked.where("found is null").select("conv_id", F.col("parent").alias("path"), F.col("key").alias("id"))


def restore(messages: DataFrame, store: DataFrame, recursive: bool = False) -> Restored:
    """Replace every message that has ``original`` by the messages it stands for, in order.

    ``store`` has (conv_id, key, id, role, content, tool_calls, original), unique by (conv_id, key); without keys, ids are keys. Without ``recursive`` one
    level is taken back; with it, up to MAX_DEPTH more, so that ids that point at one another end. Ids that the store
    lacks are reported once a round; a message with no id found stays. An empty table gives an empty one.
    """
    spark = messages.sparkSession
    made = F.col("original") if "original" in messages.columns else F.lit(None).cast(ORIGINAL)
    # An order that later levels can refine: positions as arrays, compared place by place.
    now = messages.select(*COLUMNS[:-1], made.alias("original"), F.array("pos").cast("array<int>").alias("path"))
    missing: DataFrame | None = None
    expanded, at = 0, None
    for depth in range(1 + MAX_DEPTH if recursive else 1):
        done, lost = _once(now, store, depth)
        lost = lost.withColumn("round", F.lit(depth))
        missing = lost if missing is None else missing.unionByName(lost)
        if not recursive:
            now = done
            break
        before, at = at, scratch(spark, "restore")
        done.write.parquet(at)
        done = spark.read.schema(done.schema).parquet(at)
        lost_at = scratch(spark, "restore-missing")
        missing.write.parquet(lost_at)
        missing = spark.read.schema(missing.schema).parquet(lost_at)
        if before:
            discard(spark, before)
        now = done.drop("parent")
        units = done.where("parent is not null").agg(F.countDistinct("conv_id", "parent").alias("units")).first()["units"]
        expanded += units
        if not units or not done.where("size(original.ids) > 0").limit(1).count():
            break
    if not recursive:
        counts = now.agg(F.countDistinct("conv_id", "parent").alias("units"), F.count_if(F.col("parent").isNull()).alias("passed")).first()
        expanded, passed = counts["units"], counts["passed"]
    else:
        passed = done.where("parent is null").count()
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("path")) - 1
    return Restored(now.select("conv_id", pos.alias("pos"), *COLUMNS[1:]), missing.select("conv_id", "id", "round"), expanded, passed)


def restored(messages: DataFrame, store: DataFrame) -> DataFrame:
    """The messages of ``restore`` for one level, lazily and without counts."""
    made = F.col("original") if "original" in messages.columns else F.lit(None).cast(ORIGINAL)
    now = messages.select(*COLUMNS[:-1], made.alias("original"), F.array("pos").cast("array<int>").alias("path"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("path")) - 1
    return _once(now, store, 0)[0].select("conv_id", pos.alias("pos"), *COLUMNS[1:])
