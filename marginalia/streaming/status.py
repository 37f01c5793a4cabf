"""Page status as streams: latest status, one notice for each status, counts in time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_log(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """Status changes as they are written to a folder of Parquet files, so many files in a batch at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def notices(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first done or error of each page and status; repeated ones within the watermark are dropped."""
    ended = log.where(F.col("status").isin("done", "error"))
    return ended.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["page_id", "status"])


def window_counts(log: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Status changes in tumbling windows; later ones than the watermark are not counted."""
    counted = log.withWatermark("ts", delay).groupBy(F.window("ts", length), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "status", "n")


def latest(log: DataFrame) -> DataFrame:
    """Each page's latest status, given again whenever it changes; state is one (time, id, status) for each page."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        best = now
        for batch in batches:
            for ts, i, status in zip(batch["ts"], batch["id"], batch["status"]):
                at = (int(ts.value), int(i), status)
                if best is None or at[:2] > best[:2]:
                    best = at
        if best is not None and best != now:
            state.update(best)
            yield pd.DataFrame({"page_id": [key[0]], "status": [best[2]], "id": [best[1]]})

    return log.groupBy("page_id").applyInPandasWithState(update, "page_id long, status string, id long", "at long, id long, status string", "update", GroupStateTimeout.NoTimeout)


def decisions(log: DataFrame) -> DataFrame:
    """id, page_id, decision of each request (status processing): blocked while the page is being processed, else started.

    State is a page's last (time, id, status). Changes of one trigger are taken
    in order of time; what comes later than a newer trigger is judged by the
    state that it finds.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, out = (state.get[0] if state.exists else None), []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for i, new in zip(rows["id"], rows["status"]):
            if new == "processing":
                out.append((int(i), key[0], "blocked" if status == "processing" else "started"))
            status = new
        state.update((status,))
        yield pd.DataFrame(out, columns=["id", "page_id", "decision"])

    return log.groupBy("page_id").applyInPandasWithState(update, "id long, page_id long, decision string", "status string", "append", GroupStateTimeout.NoTimeout)


def fan_out(started: DataFrame, work: Callable[[int], str], partitions: int) -> DataFrame:
    """(page_id) -> page_id, status, message: ``work`` on each page, spread by page; a failing page is an error row and stops no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch["page_id"]:
                try:
                    rows.append((page, "done", work(int(page))))
                except Exception as e:  # the work may raise anything
                    rows.append((page, "error", str(e)))
            yield pd.DataFrame(rows, columns=["page_id", "status", "message"])

    return started.select("page_id").repartition(partitions, "page_id").mapInPandas(run, "page_id long, status string, message string")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drives a stream over all that is there and returns what it gave; for tests and batch catch-up."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
