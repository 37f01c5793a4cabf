"""Page status in order of time, whatever order it arrives in, and sinks that a repeated batch does not change.

Changes wait in a page's state until the watermark has passed them; a timer on
event time then takes them up in order. A page has a timer for the first of its
changes that wait, not for each: a timer takes up all that is due and sets the
next. Changes that come later than the watermark, or than what their page has
answered, are dropped.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A page that no page is: its one change lies behind all others and moves the watermark past them.
MARKER = -1
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """A page's changes (id, status, ts) as id, page_id, status, was, at, in order of time and id; ``was`` is the status before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, status string")
        self.last = handle.getValueState("last", "status string, at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        done = tuple(self.last.get()[1:]) if self.last.exists() else None
        for batch in rows:
            for ts, i, status in zip(batch["ts"], batch["id"], batch["status"]):
                at = int(pd.Timestamp(ts).value // 1000)
                if done is None or (at, int(i)) > done:
                    new.append((at, int(i), status))
        if new:
            self.waiting.appendList(new)
            self._wake(min(new)[0])
        return iter([])

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, later = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        if not due:  # an earlier timer of this page has taken them up
            return iter([])
        was, out = self.last.get()[0] if self.last.exists() else None, []
        for at, i, status in due:
            out.append((i, key[0], status, was, at))
            was = status
        self.last.update((was, *due[-1][:2]))
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        return iter([pd.DataFrame(out, columns=["id", "page_id", "status", "was", "at"])])

    def close(self) -> None:
        pass


def in_order(log: DataFrame, delay: str) -> DataFrame:
    """id, page_id, status, was, at (microseconds) of a stream of changes (id, page_id, status, ts), page by page in order of time and id."""
    return log.withWatermark("ts", delay).groupBy("page_id").transformWithStateInPandas(
        statefulProcessor=_InOrder(), outputStructType="id long, page_id long, status string, was string, at long", outputMode="Append", timeMode="EventTime"
    )


def decided(ordered: DataFrame) -> DataFrame:
    """id, page_id, decision of the requests among ordered changes: blocked while the page is being processed, else started."""
    asked = ordered.where("status = 'processing'")
    return asked.select("id", "page_id", F.when(F.col("was") == "processing", "blocked").otherwise("started").alias("decision"))


def told_once(log: DataFrame, delay: str) -> DataFrame:
    """page_id, status of the first done or error of each page and status within the watermark."""
    ended = log.where(F.col("status").isin("done", "error"))
    return ended.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["page_id", "status"]).select("page_id", "status")


def staged(log: DataFrame, path: str, slices: int = 4, disorder: float = 0.05) -> str:
    """Writes changes (id, page_id, status, ts) as files in the order in which they might arrive, and returns the watermark's delay that loses none.

    Each change arrives up to ``disorder`` of the whole time late, by a hash of
    its id; the marker comes last.
    """
    spark = log.sparkSession
    span = log.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    first, last = (span[0] or 0), (span[1] or 0)
    late = max(1, int((last - first) * disorder))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("id"), F.lit(late))
    length = (last - first + late) // slices + 1
    dealt = log.withColumn("slice", F.floor((arrival - F.lit(first)) / F.lit(length)))
    for k in range(slices):
        dealt.where(F.col("slice") == k).drop("slice").coalesce(4).write.mode("append").parquet(path)
    marker = spark.range(1).select(F.lit(MARKER).cast("long").alias("id"), F.lit(MARKER).cast("long").alias("page_id"), F.lit("idle").alias("status"), F.timestamp_micros(F.lit(last + 10 * (late + length))).alias("ts"))
    marker.select(*[F.col(c).cast(log.schema[c].dataType) for c in log.columns]).coalesce(1).write.mode("append").parquet(path)
    return f"{math.ceil((late + length) / 1e6) + 1} seconds"


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` target with a folder for each batch: a batch that is written again takes its own place."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


@contextlib.contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def drive(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, batch by batch, into ``write``."""
    with _state_in_rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def newest(spark: SparkSession, path: str, schema, key: str, order: list[str]) -> DataFrame:
    """Of all batches' rows, each key's last by ``order``."""
    rows = spark.read.schema(schema).parquet(path)
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")
