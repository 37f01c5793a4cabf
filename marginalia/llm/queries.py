"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, judge_quality

    docs = read(spark, sf_dir, "documents")
    return judge_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens
    from .tokens import tokenizer_path

    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents"), carry=("doc_id",))


#: verdict, host, path
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge_urls, rules_frame

    judged = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 50 = 0"), rows)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract_text

    return extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import tokenizer_path

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import join_ngrams

    return join_ngrams(read(spark, sf_dir, "documents"), words=5, percent=80)


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import align_tokenizers
    from .tokens import tokenizer_path

    return align_tokenizers(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .veccodes import compress_vectors

    return compress_vectors(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_mix_sources": op5_mix_sources,
    "op6_url_rules": op6_url_rules,
    "op7_top_k": op7_top_k,
    "op8_license_scan": op8_license_scan,
    "op9_html_text": op9_html_text,
    "op10_pack_documents": op10_pack_documents,
    "op11_ngram_join": op11_ngram_join,
    "op12_align_tokenizers": op12_align_tokenizers,
    "op13_vector_codes": op13_vector_codes,
}

OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':20'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
    coalesce(greatest(floor(length(translate(text, '#*$%&|<>', ''))::DOUBLE * 100 / nullif(length(text), 0)::DOUBLE) / 100::DOUBLE, 0.05::DOUBLE), 1::DOUBLE) AS w
  FROM documents),
keyed AS (SELECT *, -ln(u) / w AS key FROM words),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, (source_size * 2)::DOUBLE AS full_,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS wt
  FROM sizes),
filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(full_) OVER (ORDER BY full_ / wt, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(wt) OVER (ORDER BY full_ / wt, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM ranked),
levels AS (SELECT *, max(CASE WHEN (total - used) / left_w * wt <= full_ THEN (total - used) / left_w END) OVER () AS level FROM filled),
budgets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN full_ ELSE least(full_, level * wt) END AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM budgets),
runs AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, CAST(k.doc_id AS VARCHAR)) AS upto
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND abs(upto - rest) <= abs(upto - size - rest) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM runs
"""

OP6_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
urls AS (
  SELECT page_id, url, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT u.n, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.n ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS k
  FROM urls u JOIN rules r ON (u.host = r.rhost OR suffix(u.host, '.' || r.rhost)) AND prefix(u.path, r.rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.n = f.n AND f.k = 1
"""

OP7_SQL = r"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP11_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
held AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM split, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS MATERIALIZED (
  SELECT x, y FROM common c JOIN sizes a ON c.x = a.doc_id JOIN sizes b ON c.y = b.doc_id WHERE 100 * c.c >= 80 * (a.n + b.n - c.c)),
ways AS MATERIALIZED (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reached(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reached r JOIN ways w ON r.y = w.x),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least l ON d.doc_id = l.x
"""

OP13_START = r"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT place, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS t(p)),
book0 AS MATERIALIZED (SELECT p, place AS e, x AS c FROM parts WHERE place < 16),
"""

#: All distances of a round; the lower entry among equals.
OP13_NEAREST = r"""
near{r} AS MATERIALIZED (
  SELECT place, p, any_value(x) AS x, min(CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + e) AS best
  FROM parts JOIN book{r} USING (p) GROUP BY place, p),
"""

OP13_MEANS = r"""
mean{r} AS MATERIALIZED (
  SELECT p, e, list(m ORDER BY i) AS c
  FROM (SELECT p, best % 16 AS e, i, CAST(floor(sum(x[i])::DOUBLE / count(*)) AS BIGINT) AS m FROM near{r}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL) GROUP BY p, e),
book{s} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e)),
"""

OP13_END = r"""
coded AS (SELECT place, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM near6 GROUP BY place)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book6) AS codebooks_sha256
FROM coded JOIN kept USING (place)
"""

OP13_SQL = OP13_START + "".join(OP13_NEAREST.format(r=r) + OP13_MEANS.format(r=r, s=r + 1) for r in range(6)) + OP13_NEAREST.format(r=6) + OP13_END

ORACLE_SQL: dict[str, str] = {
    "op5_mix_sources": OP5_SQL, "op6_url_rules": OP6_SQL, "op7_top_k": OP7_SQL, "op11_ngram_join": OP11_SQL, "op13_vector_codes": OP13_SQL,
}
