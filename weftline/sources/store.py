"""Compressed conversations on disk: messages and the store of originals, published together or not at all.

A publication is a folder of its own; the name of the current one is in a small file that is put in place by one rename,
after both tables are whole. A reader therefore never sees messages whose originals aren't there. Superseded folders stay
until ``prune``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.compress import Compressed, result_messages, verbatim

CURRENT = "current"
HISTORY = ["conv_id", "key", "id", "pos", "role", "content", "tool_calls", "original"]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current publication; None before the first."""
    files, at = _files(spark, f"{path}/{CURRENT}")
    if not files.exists(at):
        return None
    name = spark.read.text(f"{path}/{CURRENT}").first()
    return f"{path}/{name['value']}" if name else None


def publish(done: Compressed, path: str, keep_history: bool = True) -> str:
    """Write units, messages and originals under ``path``; gives the folder.

    With ``keep_history`` the originals of the current publication stay in the new one, so that messages compressed again
    can be restored all the way; a repeated key takes the newer message.
    """
    spark = done.units.sparkSession
    before = current(spark, path)
    name = f"v-{uuid.uuid4().hex[:12]}"
    folder = f"{path}/{name}"
    done.units.write.parquet(f"{folder}/units")
    units = spark.read.schema(done.units.schema).parquet(f"{folder}/units")
    result_messages(units).write.parquet(f"{folder}/messages")
    kept = verbatim(units).select(*HISTORY)
    if keep_history and before:
        older = spark.read.parquet(f"{before}/verbatim").join(kept.select("conv_id", "key"), ["conv_id", "key"], "left_anti")
        # Their positions counted the messages of their own time.
        kept = kept.unionByName(older.withColumn("pos", F.lit(None).cast(dict(older.dtypes)["pos"])).select(*HISTORY))
    kept.write.parquet(f"{folder}/verbatim")
    files, target = _files(spark, f"{path}/{CURRENT}")
    _, fresh = _files(spark, f"{path}/.{CURRENT}-{name}")
    stream = files.create(fresh, True)
    stream.write(bytearray(name.encode()))
    stream.close()
    # The one step that readers can see. Where a rename can't replace, the old file goes first: readers then find none.
    if not files.rename(fresh, target):
        files.delete(target, False)
        files.rename(fresh, target)
    return folder


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(messages, originals) of the current publication."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.parquet(f"{folder}/messages"), spark.read.parquet(f"{folder}/verbatim")


def prune(spark: SparkSession, path: str) -> int:
    """Remove superseded publications; gives their number."""
    now = current(spark, path)
    files, at = _files(spark, path)
    old = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("v-") and f"{path}/{s.getPath().getName()}" != now]
    for p in old:
        files.delete(p, True)
    return len(old)


def discover(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(path, length, modificationTime) of the session logs under ``path``, the largest first; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime").orderBy(F.desc("length"), "path")
    return found.limit(limit) if limit is not None else found
