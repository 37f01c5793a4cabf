"""Python workers that give memory back between tasks.

A worker is used again by later tasks and stages; what its allocators keep for
themselves would add up over a pipeline's stages.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a pass over texts hands to Python at once at most.
TEXTS_PER_BATCH = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as views of bounded numbers of rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_PER_BATCH):
            yield batch.slice(at, TEXTS_PER_BATCH)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers hold little: small batches, and memory given back when a task ends.

    The session's batches are made as small as texts need them, and stay so,
    as the result is computed later.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_KEY)) <= TEXTS_PER_BATCH:
        conf.set(_KEY, str(TEXTS_PER_BATCH))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(_slices(batches))
        finally:
            release()

    return df.mapInArrow(whole, schema)
