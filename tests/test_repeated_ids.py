"""Lines whose ids meet: a document with more lines than an id has room for, and a document that is there twice."""

import duckdb
import pytest

from marginalia import plans
from marginalia.operators import names as N

from .test_queries import plain

#: One document of 1,003 lines, whose last ones have ids of the next, one with a line of 50,001 characters and more, and one twice.
DOCUMENTS = [(4, "\n".join(f"wordy line {i} of the patient's court" for i in range(1003)), "src3"), (5, "Größe der Akte\ncontract and appeal\nlast words", "src5"), (6, "first. " + "long " * 10_001, "src6")]
DOCUMENTS += 2 * [(7, "enzyme and protein\nheart rate, pulse\nplain words", "src7")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("repeated"))
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", [
    "lng3_detect_language", "lng7_source_language", "prj2_translate_eligible", "sum1_summary", "trn2_translation_request",
    "dom4_dom5_detect_domain", "dom7_alternatives", "dom7_build_context", "dom7_context_text", "dom8_prompt",
])
def test_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    got, expected = plans.QUERIES[name](spark, sf).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


def test_a_request_is_in_the_language_of_its_own_text(spark):
    rows = [(1, "plain english words", "auto"), (1, "நாளைக்கு கூட்டம்", "auto"), (None, "நாளைக்கு", "auto"), (None, "more english words", "auto"), (2, "...", "ta")]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    got = sorted((r.text, r.status) for r in N.translate_request(df, lambda text, source, _target: f"{source} {text}").collect())
    assert got == sorted([("plain english words", "same"), ("நாளைக்கு கூட்டம்", "translated"), ("நாளைக்கு", "translated"), ("more english words", "same"), ("...", "translated")])
