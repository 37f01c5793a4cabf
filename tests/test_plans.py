"""Physical plans that the operators are meant to have."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia import plans
from marginalia.functions import script as S

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_queue_is_an_anti_join_and_a_top_k(spark):
    text = plan(spark, "top1_correction_queue")
    assert "LeftAnti" in text and "TakeOrderedAndProject" in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["lng3_detect_language", "dom4_dom5_detect_domain", "gat3_evidence_gate", "txt5_reliability", "jn8_ink_region", "mem2_suggestions", "win4_ink_islands", "geo4_detected_lines", "img6_ink_runs", "img7_ink_regions", "img10_aligned_lines", "jn11_img5_ordered_match", "jn12_nearest_peaks", "txt1_indexed_search"])
def test_no_python(spark, name):
    text = plan(spark, name)
    assert not any(x in text for x in ("Python", "Pandas", "Arrow", "BroadcastNestedLoop", "Cartesian"))


def test_pushdown_and_pruning(spark):
    text = plan(spark, "flt3_status_in")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text
    assert "GreaterThan(n_chars,100)" in plan(spark, "src1_table_scan")


def test_latest_model_limits_groups(spark):
    assert "WindowGroupLimit" in plan(spark, "win1_latest_model")


def test_line_votes_are_counted_where_the_pages_are(spark):
    """Pixels are dealt out by page once; votes, peaks and pieces need no other shuffle."""
    text = plan(spark, "geo4_detected_lines")
    assert text.count("hashpartitioning(page_id") <= 2 and "hashpartitioning(page_id#" in text and not any(f"hashpartitioning(page_id, {x}" in text for x in ("step", "x#", "rho"))


def test_segments_are_not_broadcast(spark):
    """Each probe makes a hundred segments, which the driver would hold all at once."""
    text = plan(spark, "jn10_fuzzy_join")
    assert "SortMergeJoin [m" in text and "Broadcast" not in text


@pytest.mark.parametrize("name", ["mem2_suggestions", "mem3_allowed"])
def test_terms_are_counted_without_a_sort(spark, name):
    """A document's terms stay where its texts were dealt; first places are numbers, which a hash table keeps."""
    text = plan(spark, name)
    assert "min(struct(" not in text and "hashpartitioning(document_id" in text and not re.search(r"hashpartitioning\(document_id#\d+L?, term", text)


@pytest.mark.parametrize("name", ["dom7_build_context", "dom7_context_text", "dom8_prompt"])
def test_a_text_is_normalised_once(spark, name):
    """Evidence, vocabulary and clues are told by the terms that were found, not by the text again."""
    text = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace(lower(") == 1 and "[^a-z" not in text


def test_scripts_are_told_in_few_steps(spark):
    """Comparisons with every range of digits made a method that the JVM does not compile; spans are those of the classes alone."""
    rng = random.Random(8)
    some = [rng.choice("aZé7²⑴❶.,$^`~_ \t\x1f\x00कবத一١𝟎😀́") for _ in range(6000)]
    texts = spark.createDataFrame([(i, "".join(some[i * 20 : i * 20 + 20])) for i in range(300)], "id long, text string")
    plainly = F.regexp_extract_all("text", F.lit("(?U)" + S._BY_CLASS), 0)
    assert texts.where(~S.spans(F.col("text")).eqNullSafe(plainly)).count() == 0
    digits = spark.createDataFrame([(chr(i),) for a, b in S.DIGIT_RANGES for i in range(a, b + 1)], "span string").select(S.script_of(F.col("span")).alias("script"))
    assert {r.script for r in digits.collect()} == {"Common"}
    assert S.text_spans(texts)._jdf.queryExecution().optimizedPlan().toString().count(">=") < 60
