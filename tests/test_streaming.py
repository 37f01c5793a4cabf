from pyspark.sql import functions as F

from marginalia.sources import views as V
from marginalia.sources.images import listed_images, listing_source, read_images
from marginalia.streaming import status as ST

SF = "/root/testdata/sf0.001"


def written(spark, tmp_path):
    log = V.status_log(spark, SF).select("id", "page_id", "status", "ts")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    return log, ST.read_log(spark, str(tmp_path / "log"), log.schema)


def test_latest_equals_batch(spark, tmp_path):
    log, stream = written(spark, tmp_path)
    told = ST.run_once(ST.latest(stream), "latest_status", "update", str(tmp_path / "c"))
    last = log.groupBy("page_id").agg(F.max_by("status", F.struct("ts", "id")).alias("status"))
    expected = {r.page_id: r.status for r in last.collect()}
    pairs = {(r.page_id, r.status) for r in told.collect()}
    assert set(expected.items()) <= pairs and {p for p, _ in pairs} == set(expected)


def test_notices_once(spark, tmp_path):
    log, stream = written(spark, tmp_path)
    got = ST.run_once(ST.notices(stream, "3650 days"), "notices", "append", str(tmp_path / "c")).select("page_id", "status").collect()
    expected = log.where(F.col("status").isin("done", "error")).select("page_id", "status").distinct().collect()
    assert sorted(got) == sorted(expected)


def test_double_starts_are_blocked(spark, tmp_path):
    from marginalia.operators import relational as R

    log, stream = written(spark, tmp_path)
    got = ST.run_once(ST.decisions(stream), "decisions", "append", str(tmp_path / "c")).collect()
    expected = R.starts(log).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and {r.decision for r in got} == {"started", "blocked"}


def test_windows(spark, tmp_path):
    log, stream = written(spark, tmp_path)
    got = ST.run_once(ST.window_counts(stream, "1 day"), "windows", "complete", str(tmp_path / "c"))
    expected = log.groupBy(F.window("ts", "1 day").start.alias("start"), "status").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_sources(spark, tmp_path):
    for name in ("a.png", "b.TXT", "c.jpeg"):
        (tmp_path / name).write_bytes(b"x")
    assert read_images(spark, str(tmp_path)).count() == 2

    def client(token):
        start = int(token or 0)
        return {"items": [{"id": str(i), "mimeType": "image/png" if i % 3 else "video/mp4", "baseUrl": None if i == 4 else f"u{i}"} for i in range(start, start + 4)]}

    spark.dataSource.register(listing_source(client, lambda: [None, "4"]))
    rows = listed_images(spark.read.format("remote_listing").load()).orderBy("page_number").collect()
    assert [(r.page_number, r.id) for r in rows] == [(1, "1"), (2, "2"), (4, "5"), (5, "7")]
