import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm.quality import fit_quality, judge_quality

from .cases import SCHEMA, documents
from .test_linededup import brute_force as linecases
from .test_neardup import brute_force as pairwise

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_documents"]

    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["quality_rules"]
    judged = judge_quality(before, fit_quality(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids(after) == ids(judged.where("kept"))
    before, after = seen["line_dedup"]
    assert after.count() <= before.count() and after.where("n_chars <> length(text)").count() == 0
    gone = linecases([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], 50)
    lines = lambda text: [x for x in (text or "").encode().split(b"\n") if x.split()]
    left = {r.doc_id: len(lines(r.text)) - gone[r.doc_id] for r in before.collect()}
    assert {r.doc_id: len(lines(r.text)) for r in after.collect()} == {i: n for i, n in left.items() if n or not gone[i]} and sum(gone.values()) > 10
    before, after = seen["near_dedup"]
    components = pairwise([tuple(r) for r in before.select("doc_id", "text").collect()], 5, 80)
    assert ids(after) == set(components.values()) < ids(before)
    words = lambda df: sum(len(r.text.encode().split()) for r in df.select("text").collect())
    before, after = seen["mix_sources"]
    assert abs(words(after) - 1.5 * words(before)) < 0.1 * words(before)
    before, after = seen["pack_documents"]
    assert after.where("piece = 0").count() == before.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


ODD = ["row", "__text", "runs", "c0", "kept", "n_removed", "size", "a.b", "lang", "n_chars"]


@pytest.mark.parametrize("case", ["odd", "nothing", "nulls"])
def test_stages_on_odd_tables(spark, tmp_path, case):
    """Nulls in every column, very long texts, repeated rows, empty tables and names that an operator might use itself."""
    rows = {"odd": documents(), "nothing": [], "nulls": [(None, None, None)] * 3}[case]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(None if c == "lang" else k).cast("long").alias(c) for k, c in enumerate(ODD)])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[1:] if case == "odd" else corpus_pipeline.STAGES:  # quality rules keep few of the odd ones
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "quality_rules":
            assert docs.count() == 0
        if name == "line_dedup" and case == "odd":
            texts = [r.text for r in docs.where("doc_id >= 1001 or doc_id is null").collect()]
            assert {None, "", " \n\t\x0b ", "a null id with some words"} <= set(texts)
            assert docs.where("n_chars <> length(text) or runs <> 2 or `a.b` <> 7").count() == 0
        if name == "near_dedup" and case == "odd":
            kept = [r.doc_id for r in docs.collect()]
            assert {None, 1001, 1002, 1003, 1004} <= set(kept) and 1005 not in kept and kept.count(3) in (0, 3)
        if name == "mix_sources" and case == "odd":
            assert docs.where("text is null or trim(text) = ''").count() == 0 and docs.where("doc_id is null").count() in (0, 1, 2)
        if name == "pack_documents":
            assert docs.where("piece = 0").count() == before.count()
        else:
            assert docs.columns == columns
    keep = corpus_pipeline.quality_rules(spark, spark.createDataFrame(documents(), SCHEMA).withColumn("__text", F.lit("X")), SF)
    assert keep.columns[-1] == "__text" and all(r["__text"] == "X" and r.text for r in keep.collect())
