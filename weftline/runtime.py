"""Session services shared by every operator: package shipping, shared scratch space, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: A join side is hinted as broadcast only when its measured size is below this many bytes.
BROADCAST_LIMIT_BYTES = 64 << 20

#: Spark's own bound on the bytes of a batch for Python; it is set only where nobody has set it.
BATCH_BYTES, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}
_scratch: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, and let it have texts in batches of a bounded size."""
    sc = spark.sparkContext
    # Rows are counted by default, whatever their length; the kernels cut batches smaller than this anyway.
    if sc.getConf().get(BATCH_BYTES) is None and spark.conf.get(BATCH_BYTES, None) == SPARKS_OWN:
        spark.conf.set(BATCH_BYTES, 8 << 20)
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="weftline-ship-")  # driver only; Spark copies the file to executors
    target = os.path.join(folder, "weftline_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, Path(_PACKAGE.name) / p.relative_to(_PACKAGE))
    sc.addPyFile(target)
    _shipped[sc.applicationId] = target


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh one only where that is unset and all runs in one process (tests).

    On a cluster a folder of the driver's machine would be read by executors that don't have it, so nothing is made up there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
        sc.setCheckpointDir(named)
        atexit.register(shutil.rmtree, local_path(named), ignore_errors=True)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def local_path(uri: str) -> str:
    """File-system path of a ``file:`` URI or plain path. Memory-mapped models need such a mount."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return parsed.path


def _discard(spark: SparkSession, uri: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone at interpreter exit
        if urlparse(uri).scheme in ("", "file"):
            shutil.rmtree(urlparse(uri).path, ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new unique folder name under the shared folder, removed when the driver ends."""
    uri = f"{shared_dir(spark).rstrip('/')}/weftline-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_discard, spark, uri)
    return uri


def discard(spark: SparkSession, uri: str) -> None:
    """Remove a scratch folder early, once nothing will read it again."""
    _discard(spark, uri)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files behind it; else they stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    uri = scratch(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)
