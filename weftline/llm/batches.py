"""Arrow-batch helpers for the row-local operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.runtime import ship

#: Rows are handed to a kernel in slices of about this many text bytes, whatever Arrow batch they came in.
SLICE_BYTES = 2 << 20


#: What this worker remembers from task to task, and whose it is. A worker runs the tasks of all operators in turn, so it
#: holds the memory of one of them at a time.
_held: tuple[Hashable, Any] | None = None


def give_back() -> None:
    """Hand freed memory back to the machine: the Arrow pool and the C allocator keep it otherwise. For workers, and the driver after training."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def remembered(owner: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's memory for ``owner``, made when first asked for; that of any other owner is dropped."""
    global _held
    if _held is None or _held[0] != owner:
        _held = None
        gc.collect()
        give_back()
        _held = (owner, make())
    return _held[1]


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``size`` bytes of ``column``; one row is never cut."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copying per row; nulls have length 0."""
    array = array.cast(pa.large_string()).fill_null("")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def map_rows(df: DataFrame, columns: list[str], schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list]], text: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """Narrow map: ``make()`` runs once a task and gives a kernel from a slice to the output columns."""
    ship(df.sparkSession)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in text_slices(batch, text, size):
                yield pa.RecordBatch.from_arrays(kernel(part), names=names)
        give_back()

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], text: str = "text") -> DataFrame:
    """Narrow filter: the kernel gives a boolean a row; every column passes through untouched."""
    ship(df.sparkSession)
    # Positional names, so that repeated or clashing column names survive the trip through Arrow.
    names = df.columns
    at = f"c{names.index(text)}"
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in text_slices(batch, at):
                mask = np.asarray(kernel(part.column(part.schema.get_field_index(at))), dtype=bool)
                yield part if mask.all() else part.filter(pa.array(mask))
        give_back()

    return flat.mapInArrow(run, flat.schema).toDF(*names)
