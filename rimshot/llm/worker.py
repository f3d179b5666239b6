"""Memory of Python workers: what is kept from one task to the next, and how much comes at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

_KEPT: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The object made for ``key``, kept for later tasks with the same key; any other is let go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of what is kept and hand free memory back; tasks that keep nothing call this before they begin, as an
    idle worker of an earlier stage would otherwise hold its memory for good."""
    if not _KEPT:
        return
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


TEXTS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session hand over at most ``TEXTS_PER_BATCH`` rows at once: a batch of whole texts lies in the
    executor's memory outside its heap, and again in the Python worker."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXTS_PER_BATCH:
        spark.conf.set(_BATCH, str(TEXTS_PER_BATCH))


def gathered(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches joined until their column has ``most_bytes``, for work that gains from many texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
