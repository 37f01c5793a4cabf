"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``. No stage fails on
nulls, empty or very long texts, repeated rows, empty tables or columns of any
further name; what each does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm.linededup import drop_repeated_lines
from marginalia.llm.mixing import mixed_documents
from marginalia.llm.neardup import drop_near_duplicates
from marginalia.llm.packing import pack_documents
from marginalia.llm.quality import fit_quality, keep_quality
from marginalia.llm.store import discard, table_path
from marginalia.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep.

    Null and empty texts fail the base rules and go; repeated rows are judged
    one by one; a null id is judged by its text like any other.
    """
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; documents of which no word is left go.

    n_chars follows the text. Null, empty and wordless texts have no lines to
    lose and stay; rows of one id and one text count as one document and get
    one text; documents with a null id come last in the order of occurrences.
    """
    cut = drop_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8 or more.

    The smallest id of a group stays, with all its rows. Texts without words
    and rows with a null id are linked to nothing and stay.
    """
    return drop_near_duplicates(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, whole.

    A null source is a source of its own; texts without words are not in the
    mix; rows that agree in id and text are taken alike.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 4096 tokens.

    Every row is a document of its own, with a null id too; a null text is an
    empty one, its end token alone.
    """
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix), ("pack_documents", pack)]

#: Trees, hashes and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again, and its predecessor's is then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = table_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
