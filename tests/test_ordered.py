"""Streams whose files arrive out of order, batches that fail after they have written, and late changes."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.operators import relational as R
from marginalia.sources import views as V
from marginalia.streaming import ordered as O
from marginalia.streaming.status import read_log

SF = "/root/testdata/sf0.001"
OUT = "id long, page_id long, status string, was string, at long, batch int"


def test_order_does_not_depend_on_arrival(spark, tmp_path):
    log = V.status_log(spark, SF).select("id", "page_id", "status", "ts")
    delay = O.staged(log, str(tmp_path / "log"), slices=5, disorder=0.2)
    first = spark.read.parquet(str(tmp_path / "log")).select("id", F.input_file_name().alias("f")).where(f"id <> {O.MARKER}")
    assert first.select("f").distinct().count() >= 5
    O.drive(O.in_order(read_log(spark, str(tmp_path / "log"), log.schema, files=1), delay), O.batch_sink(str(tmp_path / "out")), str(tmp_path / "c"))
    rows = spark.read.schema(OUT).parquet(str(tmp_path / "out")).where(f"page_id <> {O.MARKER}")
    assert rows.select("batch").distinct().count() > 2 and rows.count() == log.count() == rows.select("id").distinct().count()
    assert sorted(map(tuple, O.decided(rows).collect())) == sorted(map(tuple, R.starts(log).collect()))
    # What a page's changes follow is the change before in time, across batches.
    by_page = {}
    for r in sorted(rows.collect(), key=lambda r: (r.at, r.id)):
        assert r.was == by_page.get(r.page_id)
        by_page[r.page_id] = r.status


def test_late_changes_are_dropped(spark, tmp_path):
    from datetime import datetime

    path, schema = str(tmp_path / "log"), "id long, page_id long, status string, ts timestamp"
    at = lambda day: datetime(2024, 1, day)
    for rows in ([(1, 1, "idle", at(1)), (2, 1, "processing", at(10))], [(4, 1, "processing", at(12)), (5, 1, "done", at(11))], [(3, 1, "done", at(2))], [(-1, -1, "idle", at(28))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    O.drive(O.in_order(read_log(spark, path, spark.createDataFrame([], schema).schema, files=1), "3 days"), O.batch_sink(str(tmp_path / "out")), str(tmp_path / "c"))
    rows = spark.read.schema(OUT).parquet(str(tmp_path / "out")).where("page_id = 1").orderBy("at").collect()
    assert [(r.id, r.was) for r in rows] == [(1, None), (2, "idle"), (5, "processing"), (4, "done")]  # 3 came ten days late


def test_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "id long, n long"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select("id", (F.col("id") * 2).alias("n")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    failed = []

    def failing(rows, batch):
        O.batch_sink(str(tmp_path / "out"))(rows, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost after the write, before the commit")

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="before the commit"):
        O.drive(stream(), failing, str(tmp_path / "c"))
    O.drive(stream(), failing, str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert failed and sorted(r.id for r in got.collect()) == list(range(30)) and got.select("batch").distinct().count() == 3
    assert O.newest(spark, str(tmp_path / "out"), "id long, n long, batch int", "id", ["batch"]).count() == 30


def test_a_page_has_one_timer_however_many_changes_wait():
    """A timer for each change would wake a page as often as it has changes; each waking reads all that wait."""

    class State:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        appendList = lambda self, rows: self.rows.extend(rows)
        put = lambda self, rows: self.rows.__setitem__(slice(None), rows)
        update = lambda self, row: self.rows.__setitem__(slice(None), row)
        clear = lambda self: self.rows.clear()
        get = lambda self: tuple(self.rows)

    timers, waiting, last = [], State(), State()
    handle = SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: last, registerTimer=timers.append)
    page = O._InOrder()
    page.init(handle)
    changes = [(i, f"s{i}", pd.Timestamp(i * 1500 + 7, unit="us")) for i in range(1, 301)]
    random.Random(2).shuffle(changes)
    out = []
    for k in range(3):
        page.handleInputRows((5,), iter([pd.DataFrame(changes[k * 100 : k * 100 + 100], columns=["id", "status", "ts"])]), None)
    assert len(timers) == 3
    wakings = 0
    for watermark in (100, 333, 10_000):
        while due := [ms for ms in timers if ms <= watermark]:
            timers.remove(due[0])
            wakings += 1
            for frame in page.handleExpiredTimer((5,), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None):
                out += frame.values.tolist()
        assert all(r[4] <= watermark * 1000 for r in out)
    assert [r[0] for r in out] == list(range(1, 301)) and [r[3] for r in out] == [None, *(f"s{i}" for i in range(1, 300))] and not timers and not waiting.rows
    assert wakings <= 8
