"""The corpus model over the generated tables: documents, pages, results, corrections, models, visuals.

A transcribed line of a document stands for one recognised result on a page of
twenty lines; ids, boxes and confidences are arithmetic on document and line,
so that SQL can state the same views (:data:`SQL`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Line numbers that one document's ids have room for, and lines on a page.
ID_ROOM, PAGE_LINES = 1000, 20
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, name, source, minute (of creation)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("user_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "source", (F.col("doc_id") % 5000).alias("minute"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, document_id, page_id, n, text, x, y, w, h, confidence, struck: one row for each line that is not blank."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    lines = lines.where(F.trim("text") != "")
    n, d = F.col("n").cast("long"), F.col("document_id")
    return lines.select(
        (d * ID_ROOM + n).alias("id"), "document_id", (d * ID_ROOM + F.floor(n / PAGE_LINES)).alias("page_id"), n.alias("n"), "text",
        F.lit(40).alias("x"), (40 + (n % PAGE_LINES) * 48).cast("int").alias("y"), F.least(F.lit(920), 12 * F.length("text")).alias("w"), F.lit(40).alias("h"),
        (((d * 7919 + n * 104729) % 1001) / F.lit(1000.0)).alias("confidence"), ((d + n) % 11 == 0).alias("struck"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, document_id, page_number."""
    return results(spark, sf_dir).select(F.col("page_id").alias("id"), "document_id", (F.floor(F.col("n") / PAGE_LINES) + 1).alias("page_number")).distinct()


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, result_id, document_id, original_text, corrected_text, minute: every seventh result has been corrected."""
    r = results(spark, sf_dir).where((F.col("document_id") + F.col("n")) % 7 == 0)
    return r.select("id", F.col("id").alias("result_id"), "document_id", F.col("text").alias("original_text"), F.translate("text", LOWER, LOWER.upper()).alias("corrected_text"), (F.col("id") % 9973).alias("minute"))


def user_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, version, trained: versions of each user's model, with the corrections they were trained on."""
    version = F.floor(F.col("item_id") / 20) + 1
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).cast("int").alias("user_id"), version.alias("version"), (10 * version).alias("trained"))


def visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, page_id, element_type, x, y, w, h, geometry."""
    kinds = F.create_map(*[F.lit(x) for x in ("click", "arrow", "view", "box", "purchase", "table", "error", "underline", "signup", "circle")])
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), F.col("user_id").alias("page_id"), F.element_at(kinds, F.col("event_type")).alias("element_type"),
        (e % 900).cast("int").alias("x"), (e % 700).cast("int").alias("y"), (e % 90 + 5).cast("int").alias("w"), (e % 50 + 5).cast("int").alias("h"), F.col("props").alias("geometry"),
    )


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, page_id, status, ts, second: the status changes of pages, in time."""
    kinds = F.create_map(*[F.lit(x) for x in ("view", "idle", "click", "processing", "signup", "processing", "purchase", "done", "error", "error")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("page_id"), F.element_at(kinds, F.col("event_type")).alias("status"), F.col("ts").cast("timestamp").alias("ts"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos, ink: projection profiles of pages."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("pos", "v"))
    return p.select("page_id", "pos", F.floor(F.greatest(F.col("v").cast("double"), F.lit(0.0)) * 1000).cast("int").alias("ink"))


#: The same views as DuckDB common table expressions.
SQL = {
    "v_document": """SELECT doc_id AS id, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS user_id, 'doc-' || doc_id AS name, source, doc_id % 5000 AS minute FROM documents""",
    "v_result": """
  SELECT doc_id * 1000 + n AS id, doc_id AS document_id, doc_id * 1000 + n // 20 AS page_id, n, text, 40 AS x, CAST(40 + (n % 20) * 48 AS INTEGER) AS y,
    CAST(least(920, 12 * length(text)) AS INTEGER) AS w, 40 AS h, ((doc_id * 7919 + n * 104729) % 1001)::DOUBLE / 1000.0::DOUBLE AS confidence, (doc_id + n) % 11 = 0 AS struck
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)
  WHERE trim(text) <> ''""",
    "v_page": "SELECT DISTINCT page_id AS id, document_id, n // 20 + 1 AS page_number FROM v_result",
    "v_correction": "SELECT id, id AS result_id, document_id, text AS original_text, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS corrected_text, id % 9973 AS minute FROM v_result WHERE (document_id + n) % 7 = 0",
    "v_user_model": "SELECT CAST(item_id % 20 AS INTEGER) AS user_id, item_id // 20 + 1 AS version, 10 * (item_id // 20 + 1) AS trained FROM benchmark",
    "v_visual": """SELECT event_id AS id, user_id AS page_id, CASE event_type WHEN 'click' THEN 'arrow' WHEN 'view' THEN 'box' WHEN 'purchase' THEN 'table' WHEN 'error' THEN 'underline' WHEN 'signup' THEN 'circle' END AS element_type,
    CAST(event_id % 900 AS INTEGER) AS x, CAST(event_id % 700 AS INTEGER) AS y, CAST(event_id % 90 + 5 AS INTEGER) AS w, CAST(event_id % 50 + 5 AS INTEGER) AS h, props AS geometry FROM events""",
    "v_status": """SELECT event_id AS id, user_id AS page_id, CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' END AS status,
    ts, CAST(floor(epoch(ts)) AS BIGINT) AS second FROM events""",
    "v_profile": """SELECT vec_id AS page_id, CAST(pos AS INTEGER) AS pos, CAST(floor(greatest(v::DOUBLE, 0.0::DOUBLE) * 1000) AS INTEGER) AS ink
  FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)""",
}
_NEEDS = {"v_page": ["v_result"], "v_correction": ["v_result"]}


def with_views(sql: str) -> str:
    """``sql`` behind the definitions of the views that it names."""
    named = [v for v in SQL if v in sql]
    wanted = [v for v in SQL if v in named or any(v in _NEEDS.get(n, ()) for n in named)]
    if not wanted:
        return sql
    head = ",\n".join(f"{v} AS ({SQL[v]})" for v in wanted)
    body = sql.lstrip()
    for begin in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(begin):
            return f"{begin}{head},\n{body[len(begin):]}"
    return f"WITH {head}\n{body}"
