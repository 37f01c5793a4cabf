"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Folders made for applications on one machine that have none set.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; a fresh local one where none is set (single-machine tests)."""
    found = spark.conf.get(KEY, None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        found = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/marginalia/{tag}-{uuid.uuid4().hex}"


#: Tables of the innermost :func:`scratch` of this thread.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    computing ``df`` again. Within :func:`scratch` the table is deleted at the
    end, unless it is to be kept for a result that reads it later.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.parquet(path)
    made = _SCRATCH.get()
    if made is not None and not keep:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within it and not kept are deleted at its end: what remains must not read them."""
    token = _SCRATCH.set(made := [])
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            discard(spark, path)


@contextlib.contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, actions hand Python at most so many rows at once: for rows that hold whole groups."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
