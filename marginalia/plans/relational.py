"""Ownership, joins, aggregates, rankings and changes of state, over the corpus views."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import geometry as G
from ..operators import relational as R
from ..sources import views as V
from ..streaming import status as ST
from .registry import query

USER = 3


@query("flt1_owned_results", f"""SELECT r.id, r.page_id, p.page_number, d.name, r.text FROM v_result r JOIN v_page p ON r.page_id = p.id
JOIN v_document d ON p.document_id = d.id WHERE d.user_id = {USER}""")
def owned(s, d):
    return R.owned(V.results(s, d), V.pages(s, d), V.documents(s, d), USER).select("id", "page_id", "page_number", "name", "text")


@query("flt2_point_lookup", f"SELECT id, name, source FROM v_document WHERE id = 3 AND user_id = {USER}")
def point(s, d):
    return V.documents(s, d).where((F.col("id") == 3) & (F.col("user_id") == USER)).select("id", "name", "source")


@query("flt3_status_in", "SELECT id, page_id, status FROM v_status WHERE status IN ('processing', 'done', 'error')")
def status_in(s, d):
    return V.status_log(s, d).where(F.col("status").isin("processing", "done", "error")).select("id", "page_id", "status")


@query("flt4_hide_struck", "SELECT id, text FROM v_result WHERE NOT struck")
def hide_struck(s, d):
    return V.results(s, d).where(~F.col("struck")).select("id", "text")


@query("flt5_name_contains", "SELECT id, name FROM v_document WHERE contains(lower(name), lower('DOC-1'))")
def name_contains(s, d):
    return V.documents(s, d).where(F.lower("name").contains("doc-1")).select("id", "name")


@query("flt6_box_defaults", "SELECT id, coalesce(nullif(x, 0), 0) AS x, coalesce(y, 0) AS y, coalesce(nullif(w, 0), 1) AS w, coalesce(nullif(h, 0), 1) AS h FROM v_result WHERE trim(text) <> ''")
def box_defaults(s, d):
    r = V.results(s, d).where(F.trim("text") != "")
    or_one = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1)).alias(c)
    return r.select("id", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"), or_one("w"), or_one("h"))


@query("flt7_start_gate", "SELECT id, status IS DISTINCT FROM 'processing' AS can_start FROM v_status")
def start_gate(s, d):
    return V.status_log(s, d).select("id", (~F.col("status").eqNullSafe("processing")).alias("can_start"))


@query("flt8_arrows_only", "SELECT id, page_id FROM v_visual WHERE element_type = 'arrow'")
def arrows(s, d):
    return V.visuals(s, d).where("element_type = 'arrow'").select("id", "page_id")


@query("prj1_confidence_bucket", "SELECT id, CASE WHEN confidence > 0.8::DOUBLE THEN 'High' WHEN confidence >= 0.5::DOUBLE THEN 'Medium' ELSE 'Low' END AS bucket, CAST(floor(confidence * 100 + 0.5::DOUBLE) AS BIGINT) AS percent FROM v_result")
def bucket(s, d):
    c = F.col("confidence")
    return V.results(s, d).select("id", F.when(c > 0.8, "High").when(c >= 0.5, "Medium").otherwise("Low").alias("bucket"), F.floor(c * 100 + 0.5).alias("percent"))


@query("prj3_nested_document", """SELECT d.id, p.page_number, count(*) AS n_results, min(r.id) AS first_id FROM v_document d JOIN v_page p ON p.document_id = d.id JOIN v_result r ON r.page_id = p.id GROUP BY d.id, p.page_number""")
def nested(s, d):
    r = V.results(s, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "id", "text"))).alias("results"))
    p = V.pages(s, d).join(r, F.col("id") == F.col("page_id")).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "results"))).alias("pages"))
    docs = V.documents(s, d).join(p.withColumnRenamed("document_id", "id"), "id")
    flat = docs.select("id", F.explode("pages").alias("p"))
    return flat.select("id", "p.page_number", F.size("p.results").cast("long").alias("n_results"), F.get(F.col("p.results.id"), F.lit(0)).alias("first_id"))


@query("prj4_validation", """SELECT id, length(text) >= 1 AS text_ok, length(text) <= 500 AS query_ok, confidence BETWEEN 0 AND 1 AS confidence_ok,
regexp_matches(source, '^(upload|camera|google_photos)$') AS source_ok FROM (SELECT r.*, 'upload' AS source FROM v_result r)""")
def validation(s, d):
    n = F.length("text")
    return V.results(s, d).withColumn("source", F.lit("upload")).select("id", (n >= 1).alias("text_ok"), (n <= 500).alias("query_ok"), F.col("confidence").between(0, 1).alias("confidence_ok"), F.col("source").rlike("^(upload|camera|google_photos)$").alias("source_ok"))


@query("jn1_page_document", "SELECT p.id, p.page_number, d.name FROM v_page p JOIN v_document d ON p.document_id = d.id")
def page_document(s, d):
    return V.pages(s, d).join(V.documents(s, d).select(F.col("id").alias("document_id"), "name"), "document_id").select("id", "page_number", "name")


@query("jn2_result_page_document", "SELECT r.id, p.page_number, d.user_id FROM v_result r JOIN v_page p ON r.page_id = p.id JOIN v_document d ON p.document_id = d.id")
def three_way(s, d):
    p = V.pages(s, d).select(F.col("id").alias("page_id"), "page_number", "document_id")
    docs = V.documents(s, d).select(F.col("id").alias("document_id"), "user_id")
    return V.results(s, d).drop("document_id").join(p, "page_id").join(docs, "document_id").select("id", "page_number", "user_id")


@query("jn3_corrections_4way", "SELECT c.id, c.corrected_text, p.page_number, d.name FROM v_correction c JOIN v_result r ON c.result_id = r.id JOIN v_page p ON r.page_id = p.id JOIN v_document d ON p.document_id = d.id")
def four_way(s, d):
    r = V.results(s, d).select(F.col("id").alias("result_id"), "page_id")
    p = V.pages(s, d).select(F.col("id").alias("page_id"), "page_number", "document_id")
    docs = V.documents(s, d).select(F.col("id").alias("document_id"), "name")
    return V.corrections(s, d).drop("document_id").join(r, "result_id").join(p, "page_id").join(docs, "document_id").select("id", "corrected_text", "page_number", "name")


COUNTS_SQL = """SELECT d.id AS document_id, d.name, coalesce(p.c, 0) AS page_count, coalesce(r.c, 0) AS result_count FROM v_document d
LEFT JOIN (SELECT document_id, count(*) AS c FROM v_page GROUP BY 1) p ON p.document_id = d.id LEFT JOIN (SELECT document_id, count(*) AS c FROM v_result GROUP BY 1) r ON r.document_id = d.id"""


@query("jn4_agg1_document_counts", COUNTS_SQL)
def counts(s, d):
    return R.document_counts(V.documents(s, d), V.pages(s, d), V.results(s, d)).select("document_id", "name", "page_count", "result_count")


@query("jn5_uncorrected", "SELECT id, confidence FROM v_result r WHERE NOT EXISTS (SELECT 1 FROM v_correction c WHERE c.result_id = r.id)")
def uncorrected(s, d):
    return R.uncorrected(V.results(s, d), V.corrections(s, d)).select("id", "confidence")


@query("jn6_ranked_hits", "SELECT h.rank, r.id, r.text FROM (SELECT id, CAST(row_number() OVER (ORDER BY confidence DESC, id) AS INTEGER) AS rank FROM v_result QUALIFY rank <= 30) h JOIN v_result r ON r.id = h.id")
def ranked_hits(s, d):
    r = V.results(s, d)
    top = r.orderBy(F.col("confidence").desc(), "id").limit(30).select("id", "confidence")
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("confidence").desc(), "id"))).select("id", "rank")
    return r.join(ranked, "id").select("rank", "id", "text")


@query("jn7_eager_pages", "SELECT p.document_id, p.page_number, r.id AS result_id FROM v_page p LEFT JOIN v_result r ON r.page_id = p.id")
def eager(s, d):
    own = V.results(s, d).groupBy("page_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    p = V.pages(s, d).join(own, F.col("id") == F.col("page_id"), "left")
    return p.select("document_id", "page_number", F.explode_outer("ids").alias("result_id"))


REGIONS_SQL = """regions AS (SELECT page_id, label, rx, ry, rw, rh, region_index, full_page FROM (SELECT DISTINCT page_id FROM v_result)
  CROSS JOIN (VALUES ('MAIN_INK', 0, 0, 1000, 1000, 0, true), ('margin_note', 0, 30, 200, 120, 1, false), ('revision', 100, 200, 600, 90, 2, false), ('stamp', 0, 600, 300, 200, 3, false)) AS t(label, rx, ry, rw, rh, region_index, full_page))"""


def regions(s, d):
    """Four ink regions on each page."""
    listed = [("MAIN_INK", 0, 0, 1000, 1000, 0, True), ("margin_note", 0, 30, 200, 120, 1, False), ("revision", 100, 200, 600, 90, 2, False), ("stamp", 0, 600, 300, 200, 3, False)]
    names = ("label", "rx", "ry", "rw", "rh", "region_index", "full_page")
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in listed])
    return V.results(s, d).select("page_id").distinct().select("page_id", F.inline(structs))


@query("jn8_ink_region", f"""WITH {REGIONS_SQL},
hits AS (SELECT v.id, r.label, row_number() OVER (PARTITION BY v.id ORDER BY r.region_index) AS k FROM v_result v JOIN regions r ON v.page_id = r.page_id AND NOT r.full_page
  AND least(v.x + v.w, r.rx + r.rw) - greatest(v.x, r.rx) > 0 AND least(v.y + v.h, r.ry + r.rh) - greatest(v.y, r.ry) > 0)
SELECT v.id, coalesce(h.label, 'MAIN_INK') AS label FROM v_result v LEFT JOIN hits h ON h.id = v.id AND h.k = 1""")
def ink_region(s, d):
    return R.region_of(V.results(s, d), regions(s, d)).select("id", "label")


@query("jn9_region_by_iou", f"""WITH {REGIONS_SQL},
scored AS (SELECT v.id, r.label, r.region_index, greatest(0, least(v.x + v.w, r.rx + r.rw) - greatest(v.x, r.rx)) * greatest(0, least(v.y + v.h, r.ry + r.rh) - greatest(v.y, r.ry)) AS inter, v.w * v.h + r.rw * r.rh AS both_
  FROM v_result v JOIN regions r ON v.page_id = r.page_id WHERE NOT r.full_page),
hits AS (SELECT id, label, inter::DOUBLE / (both_ - inter)::DOUBLE AS score, row_number() OVER (PARTITION BY id ORDER BY region_index) AS k FROM scored WHERE inter::DOUBLE / (both_ - inter)::DOUBLE > 0.25::DOUBLE)
SELECT v.id, coalesce(h.label, 'MAIN_INK') AS label, coalesce(h.score, 0.7::DOUBLE) AS score FROM v_result v LEFT JOIN hits h ON h.id = v.id AND h.k = 1""")
def iou_region(s, d):
    return R.region_by_iou(V.results(s, d), regions(s, d).where("not full_page"))


@query("jn14_translation_map", "SELECT r.id, coalesce(t.corrected_text, r.text) AS shown FROM v_result r LEFT JOIN v_correction t ON t.result_id = r.id WHERE NOT r.struck")
def translation_map(s, d):
    t = V.corrections(s, d).select(F.col("result_id").alias("id"), "corrected_text")
    return V.results(s, d).where("not struck").join(t, "id", "left").select("id", F.coalesce("corrected_text", "text").alias("shown"))


@query("agg2_document_corrections", "SELECT document_id, count(*) AS n FROM v_correction GROUP BY 1")
def document_corrections(s, d):
    return V.corrections(s, d).groupBy("document_id").agg(F.count("*").alias("n"))


@query("agg3_user_corrections", f"SELECT count(*) AS n FROM v_correction c JOIN v_document d ON c.document_id = d.id WHERE d.user_id = {USER}")
def user_corrections(s, d):
    own = V.documents(s, d).where(F.col("user_id") == USER).select(F.col("id").alias("document_id"))
    return V.corrections(s, d).join(own, "document_id", "left_semi").agg(F.count("*").alias("n"))


@query("agg4_remaining", """SELECT d.user_id, greatest(0, count(*) - 10) AS remaining FROM v_result r JOIN v_document d ON r.document_id = d.id
WHERE NOT EXISTS (SELECT 1 FROM v_correction c WHERE c.result_id = r.id) GROUP BY 1""")
def remaining(s, d):
    return R.remaining(V.documents(s, d), V.results(s, d), V.corrections(s, d))


@query("agg5_distinct_corrected", "SELECT DISTINCT result_id FROM v_correction")
def distinct_corrected(s, d):
    return V.corrections(s, d).select("result_id").distinct()


@query("agg6_best_rotation", """WITH means AS (SELECT page_id, CAST(n % 4 * 90 AS INTEGER) AS rotation, sum(CAST(round(confidence * 1000) AS BIGINT))::DOUBLE / count(*)::DOUBLE AS mean FROM v_result GROUP BY 1, 2)
SELECT page_id, rotation, mean AS mean_confidence FROM means QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY mean DESC, rotation) = 1""")
def best_rotation(s, d):
    trials = V.results(s, d).select("page_id", (F.col("n") % 4 * 90).cast("int").alias("rotation"), F.round(F.col("confidence") * 1000).cast("long").alias("confidence"))
    return R.best_rotation(trials)


STATUS_SQL = """totals AS (SELECT d.user_id, count(*) AS total FROM v_correction c JOIN v_document d ON c.document_id = d.id GROUP BY 1),
latest AS (SELECT * FROM v_user_model QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC, trained DESC) = 1),
status AS (SELECT u.user_id, l.version IS NOT NULL AS has_model, l.version, coalesce(t.total, 0) AS total, coalesce(t.total, 0) - coalesce(l.trained, 0) AS since
  FROM (SELECT DISTINCT user_id FROM v_document) u LEFT JOIN totals t ON u.user_id = t.user_id LEFT JOIN latest l ON u.user_id = l.user_id)"""


def _status(s, d):
    return R.model_status(V.documents(s, d), V.corrections(s, d), V.user_models(s, d))


@query("agg7_model_status", f"WITH {STATUS_SQL} SELECT * FROM status")
def model_status(s, d):
    return _status(s, d)


@query("agg8_element_counts", "SELECT page_id, count(*) FILTER (element_type = 'arrow') AS arrows, count(*) FILTER (element_type = 'table') AS tables FROM v_visual GROUP BY 1")
def element_counts(s, d):
    return V.visuals(s, d).groupBy("page_id").agg(*[F.count_if(F.col("element_type") == t).alias(f"{t}s") for t in ("arrow", "table")])


@query("agg9_page_text", "SELECT page_id, string_agg(trim(text), chr(10) ORDER BY y, x, id) AS page_text FROM v_result WHERE trim(text) <> '' GROUP BY 1")
def page_text(s, d):
    return R.page_text(V.results(s, d))


@query("agg10_upper_median", "SELECT page_id, CAST(list_sort(list(w))[len(list(w)) // 2 + 1] AS INTEGER) AS median_w FROM v_result GROUP BY 1")
def upper_median(s, d):
    return V.results(s, d).groupBy("page_id").agg(R.upper_median(F.col("w")).alias("median_w"))


@query("agg11_median_mad", """WITH m AS (SELECT page_id, quantile_cont(ink::DOUBLE, 0.5) AS med, quantile_cont(ink::DOUBLE, 0.25) AS p25 FROM v_profile GROUP BY 1)
SELECT m.page_id, any_value(m.med) AS med, any_value(m.p25) AS p25, quantile_cont(abs(v.ink - m.med), 0.5) AS mad FROM v_profile v JOIN m ON v.page_id = m.page_id GROUP BY 1""")
def median_mad(s, d):
    own = V.profiles(s, d).groupBy("page_id").agg(F.percentile("ink", 0.5).alias("med"), F.percentile("ink", 0.25).alias("p25"), F.collect_list("ink").alias("inks"))
    spread = F.explode("inks").alias("ink")
    return own.select("page_id", "med", "p25", spread).groupBy("page_id").agg(F.first("med").alias("med"), F.first("p25").alias("p25"), F.percentile(F.abs(F.col("ink") - F.col("med")), 0.5).alias("mad"))


@query("srt1_newest_documents", "SELECT id, name, CAST(row_number() OVER (ORDER BY minute DESC, id DESC) AS INTEGER) AS place FROM v_document QUALIFY place <= 50")
def newest(s, d):
    top = V.documents(s, d).orderBy(F.col("minute").desc(), F.col("id").desc()).limit(50)
    return top.select("id", "name", F.row_number().over(Window.orderBy(F.col("minute").desc(), F.col("id").desc())).alias("place"))


@query("srt2_reading_order", "SELECT id, page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y, x, id) AS INTEGER) AS place FROM v_result")
def reading_order(s, d):
    return V.results(s, d).select("id", "page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "id")).alias("place"))


@query("srt3_correction_page", "SELECT id, corrected_text FROM v_correction ORDER BY minute DESC, id DESC LIMIT 50 OFFSET 100")
def correction_page(s, d):
    return V.corrections(s, d).orderBy(F.col("minute").desc(), F.col("id").desc()).offset(100).limit(50).select("id", "corrected_text")


@query("top1_correction_queue", f"""SELECT r.id, r.document_id, d.name, r.text, r.confidence, coalesce(c.n, 0) AS document_corrections FROM v_result r JOIN v_document d ON r.document_id = d.id
LEFT JOIN (SELECT document_id, count(*) AS n FROM v_correction GROUP BY 1) c ON c.document_id = r.document_id
WHERE d.user_id = {USER} AND NOT EXISTS (SELECT 1 FROM v_correction x WHERE x.result_id = r.id) ORDER BY r.confidence, document_corrections DESC, r.id LIMIT 50""")
def queue(s, d):
    return R.correction_queue(V.documents(s, d), V.results(s, d), V.corrections(s, d), USER, 50)


@query("win1_latest_model", "SELECT user_id, version, trained FROM v_user_model QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC, trained DESC) = 1")
def latest_model(s, d):
    return R.latest_models(V.user_models(s, d))


U_SQL = """u AS (SELECT r.id, r.text, r.document_id, least(greatest(r.confidence, 1e-9::DOUBLE), 1::DOUBLE - 1e-9::DOUBLE) AS c, k.id IS NOT NULL AS corrected FROM v_result r LEFT JOIN v_correction k ON k.result_id = r.id),
scored AS (SELECT *, 0.5::DOUBLE * (1 - c) + 0.5::DOUBLE * -(c * log2(c) + (1 - c) * log2(1 - c)) - CASE WHEN corrected THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS score FROM u)"""


def scored(s, d):
    done = V.corrections(s, d).select(F.col("result_id").alias("id"), F.lit(True).alias("corrected"))
    r = V.results(s, d).join(done, "id", "left").withColumn("corrected", F.coalesce("corrected", F.lit(False)))
    return r.withColumn("score", R.uncertainty(F.col("confidence"), F.col("corrected")))


@query("win2_priority_ranker", f"WITH {U_SQL} SELECT id, CAST(floor(score * 1000000 + 0.5::DOUBLE) AS BIGINT) AS score_ppm FROM scored")
def ranker(s, d):
    return scored(s, d).select("id", F.floor(F.col("score") * 1000000 + 0.5).alias("score_ppm"))


@query("win5_line_spacing", """WITH gaps AS (SELECT page_id, id, y, lead(y) OVER (PARTITION BY page_id ORDER BY y, id) - y AS gap FROM v_result),
med AS (SELECT page_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS m FROM gaps WHERE gap IS NOT NULL GROUP BY 1)
SELECT g.page_id, CAST(any_value(m) AS INTEGER) AS median_gap, CAST(min(CASE WHEN abs(g.gap - m) < 0.3::DOUBLE * m THEN g.y END) AS INTEGER) AS first_y FROM gaps g JOIN med ON g.page_id = med.page_id GROUP BY 1""")
def spacing(s, d):
    w = Window.partitionBy("page_id").orderBy("y", "id")
    gaps = V.results(s, d).select("page_id", "y", (F.lead("y").over(w) - F.col("y")).alias("gap"))
    med = gaps.where("gap is not null").groupBy("page_id").agg(R.upper_median(F.col("gap")).alias("m"))
    near = F.when(F.abs(F.col("gap") - F.col("m")) < 0.3 * F.col("m"), F.col("y"))
    return gaps.join(med, "page_id").groupBy("page_id").agg(F.first("m").alias("median_gap"), F.min(near).alias("first_y"))


@query("win8_word_boxes", r"""WITH split AS (SELECT id, x, w, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ws FROM v_result),
words AS (SELECT id, x, w, len(ws) > 1 AND w >= 40 AS cut, unnest(CASE WHEN len(ws) > 1 AND w >= 40 THEN ws ELSE list_value(text) END) AS word, unnest(range(CASE WHEN len(ws) > 1 AND w >= 40 THEN len(ws) ELSE 1 END)) AS i FROM split),
run AS (SELECT *, greatest(1, length(word)) * 10 AS weight, sum(greatest(1, length(word)) * 10 + 7) OVER (PARTITION BY id ORDER BY i) - (greatest(1, length(word)) * 10 + 7) AS before_, sum(greatest(1, length(word)) * 10 + 7) OVER (PARTITION BY id) - 7 AS total FROM words),
ends AS (SELECT *, round_even(x + before_ * w::DOUBLE / total::DOUBLE, 0) AS a, round_even(x + before_ * w::DOUBLE / total::DOUBLE + weight * w::DOUBLE / total::DOUBLE, 0) AS b FROM run)
SELECT id, CAST(i AS INTEGER) AS i, word, CAST(CASE WHEN cut THEN a ELSE x END AS BIGINT) AS word_x, CAST(CASE WHEN cut THEN greatest(1, b - a) ELSE w END AS BIGINT) AS word_w FROM ends""")
def word_boxes(s, d):
    return G.word_boxes(V.results(s, d))


@query("win9_extrapolated_lines", """WITH last AS (SELECT page_id, max(y) AS last_y, count(*) AS k FROM v_result GROUP BY 1)
SELECT page_id, CAST(last_y + i * 48 AS INTEGER) AS y FROM last, range(1, 4) t(i) WHERE k < 20""")
def extrapolated(s, d):
    last = V.results(s, d).groupBy("page_id").agg(F.max("y").alias("last_y"), F.count("*").alias("k")).where("k < 20")
    return last.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.col("last_y") + i * 48).cast("int"))).alias("y"))


@query("win10_next_version", "SELECT user_id, max(version) + 1 AS next_version, max(CAST(regexp_extract('models/v' || version, 'v(\\d+)', 1) AS BIGINT)) AS latest_dir FROM v_user_model GROUP BY 1")
def next_version(s, d):
    path = F.concat(F.lit("models/v"), F.col("version").cast("string"))
    return V.user_models(s, d).groupBy("user_id").agg((F.max("version") + 1).alias("next_version"), F.max(F.regexp_extract(path, r"v(\d+)", 1).cast("long")).alias("latest_dir"))


@query("dml1_latest_text", "SELECT r.id, coalesce(c.corrected_text, r.text) AS text FROM v_result r LEFT JOIN (SELECT result_id, max_by(corrected_text, (minute, id)) AS corrected_text FROM v_correction GROUP BY 1) c ON c.result_id = r.id")
def latest_text(s, d):
    return R.latest_text(V.results(s, d), V.corrections(s, d)).select("id", "text")


@query("dml2_reprocess", "SELECT id, page_id, text FROM v_result WHERE page_id % 1000 <> 0 UNION ALL SELECT id, page_id, lower(text) FROM v_result WHERE page_id % 1000 = 0 AND n % 2 = 0")
def reprocess(s, d):
    """First pages are recognised anew: their old results go, every other line comes back in lower case."""
    r = V.results(s, d)
    first = r.where("page_id % 1000 = 0")
    fresh = first.where("n % 2 = 0").select("id", "page_id", F.lower("text").alias("text"))
    return R.replaced(r.select("id", "page_id", "text"), fresh, first.select("page_id"), "page_id")


@query("dml3_rotate", "SELECT id, page_id FROM v_result WHERE page_id NOT IN (SELECT id FROM v_page WHERE page_number = 1)")
def rotate(s, d):
    turned = V.pages(s, d).where("page_number = 1").select(F.col("id").alias("page_id"))
    return V.results(s, d).join(turned, "page_id", "left_anti").select("id", "page_id")


@query("dml4_delete_document", """SELECT 'document' AS kind, count(*) AS n FROM v_document WHERE id <> 3 UNION ALL SELECT 'page', count(*) FROM v_page WHERE document_id <> 3
UNION ALL SELECT 'result', count(*) FROM v_result WHERE document_id <> 3 UNION ALL SELECT 'correction', count(*) FROM v_correction WHERE document_id <> 3""")
def delete_document(s, d):
    left = R.drop_document(3, V.documents(s, d), V.pages(s, d), V.results(s, d), V.corrections(s, d))
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in zip(("document", "page", "result", "correction"), left)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("dml5_user_upsert", "SELECT coalesce(i.c_custkey, e.c_custkey) AS c_custkey, coalesce(i.c_name, e.c_name) AS c_name FROM customer e FULL JOIN (SELECT c_custkey + 100 AS c_custkey, upper(c_name) AS c_name FROM customer) i ON e.c_custkey = i.c_custkey")
def user_upsert(s, d):
    existing = V.table(s, d, "customer").select("c_custkey", "c_name")
    incoming = existing.select((F.col("c_custkey") + 100).alias("c_custkey"), F.upper("c_name").alias("c_name"))
    return R.upsert(existing, incoming, "c_custkey")


@query("dml6_training_gate", f"WITH {STATUS_SQL} SELECT user_id, CASE WHEN total = 0 THEN 'no corrections' WHEN since <= 0 THEN 'nothing new' ELSE 'start' END AS decision, coalesce(version, 0) + 1 AS next_version FROM status")
def training_gate(s, d):
    return R.training_gate(_status(s, d))


@query("dml7_training_set", "SELECT c.id, c.corrected_text, r.x, r.y, r.w, r.h FROM v_correction c JOIN v_result r ON c.result_id = r.id")
def training_set(s, d):
    boxes = V.results(s, d).select(F.col("id").alias("result_id"), "x", "y", "w", "h")
    return V.corrections(s, d).join(boxes, "result_id").select("id", "corrected_text", "x", "y", "w", "h")


@query("str1_latest_status", "SELECT page_id, arg_max(status, (ts, id)) AS status FROM v_status GROUP BY 1")
def latest_status(s, d):
    return V.status_log(s, d).groupBy("page_id").agg(F.max_by("status", F.struct("ts", "id")).alias("status"))


@query("str2_status_report", "SELECT status, count(*) AS pages FROM (SELECT page_id, arg_max(status, (ts, id)) AS status FROM v_status GROUP BY 1) GROUP BY 1")
def status_report(s, d):
    return latest_status(s, d).groupBy("status").agg(F.count("*").alias("pages"))


@query("str3_notify_once", "SELECT DISTINCT page_id, status FROM v_status WHERE status IN ('done', 'error')")
def notify_once(s, d):
    return V.status_log(s, d).where(F.col("status").isin("done", "error")).select("page_id", "status").dropDuplicates()


@query("str1_double_start", """WITH before_ AS (SELECT *, lag(status) OVER (PARTITION BY page_id ORDER BY ts, id) AS was FROM v_status)
SELECT id, page_id, CASE WHEN was = 'processing' THEN 'blocked' ELSE 'started' END AS decision FROM before_ WHERE status = 'processing'""")
def double_start(s, d):
    return R.starts(V.status_log(s, d))


@query("dml8_calibration", """WITH asked AS (SELECT p.id AS page_id, d.user_id, 'line ' || p.document_id AS text, (p.id % 90) / 100.0::DOUBLE AS confidence, 'Line ' || p.document_id AS truth FROM v_page p JOIN v_document d ON d.id = p.document_id WHERE p.page_number = 1),
latest AS (SELECT user_id, max(version) AS version FROM v_user_model GROUP BY 1), made AS (SELECT d.user_id, count(*) AS n FROM v_correction c JOIN v_result r ON r.id = c.result_id JOIN v_document d ON d.id = r.document_id GROUP BY 1)
SELECT a.page_id, a.text AS original_text, a.truth AS corrected_text, CASE WHEN l.version IS NULL THEN 'base' ELSE 'user-v' || l.version END AS model_version, 'mixed' = 'x' AS from_gemini, coalesce(l.version, 0) + 1 AS new_version,
  CAST(coalesce(m.n, 0) + count(*) OVER (PARTITION BY a.user_id) AS BIGINT) AS num_corrections FROM asked a LEFT JOIN latest l USING (user_id) LEFT JOIN made m USING (user_id)""".replace(", 'mixed' = 'x' AS from_gemini", ""))
def calibration(s, d):
    """Each document's first page is calibrated with a line of known text."""
    docs = V.documents(s, d).select(F.col("id").alias("document_id"), "user_id")
    asked = V.pages(s, d).where("page_number = 1").join(docs, "document_id").select(
        F.col("id").alias("page_id"), "user_id", F.concat(F.lit("line "), F.col("document_id").cast("string")).alias("text"), ((F.col("id") % 90) / 100.0).alias("confidence"),
        F.concat(F.lit("Line "), F.col("document_id").cast("string")).alias("truth"),
    )
    own = V.corrections(s, d).join(docs, "document_id").groupBy("user_id").agg(F.count("*").alias("corrections"))
    rows = R.calibrated(asked, V.user_models(s, d), own)
    return rows.select("page_id", "original_text", "corrected_text", "model_version", "new_version", "num_corrections")


@query("dml9_training_settings", """WITH made AS (SELECT d.user_id, count(*) AS n FROM v_correction c JOIN v_result r ON r.id = c.result_id JOIN v_document d ON d.id = r.document_id GROUP BY 1), latest AS (SELECT user_id, max(version) AS version FROM v_user_model GROUP BY 1)
SELECT user_id, l.version AS resumed_from, coalesce(l.version, 0) + 1 AS version, 3 AS epochs, CAST(least(4, n) AS BIGINT) AS batch_size, CAST(greatest(1, n // 4) AS BIGINT) AS warmup_steps, 0.00005::DOUBLE AS learning_rate, 0.01::DOUBLE AS weight_decay, 8 AS rank, 16 AS alpha
FROM made m LEFT JOIN latest l USING (user_id)""")
def training_settings(s, d):
    docs = V.documents(s, d).select(F.col("id").alias("document_id"), "user_id")
    own = V.corrections(s, d).join(docs, "document_id").groupBy("user_id").agg(F.count("*").alias("corrections"))
    return R.training_settings(own, V.user_models(s, d))


# Pages whose start was granted are worked on; every ninth fails.
@query("str4_page_fan_out", """WITH before_ AS (SELECT *, lag(status) OVER (PARTITION BY page_id ORDER BY ts, id) AS was FROM v_status)
SELECT DISTINCT page_id, CASE WHEN page_id % 9 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN page_id % 9 = 0 THEN 'page ' || page_id ELSE 'read ' || page_id END AS message FROM before_ WHERE status = 'processing' AND was IS DISTINCT FROM 'processing'""")
def page_fan_out(s, d):
    def work(page: int) -> str:
        if page % 9 == 0:
            raise ValueError(f"page {page}")
        return f"read {page}"

    pages = double_start(s, d).where("decision = 'started'").select("page_id").distinct()
    return ST.fan_out(pages, work, int(s.conf.get("spark.sql.shuffle.partitions")))


@query("plg3_model_choice", """SELECT u.user_id, CASE WHEN max(version) IS NULL THEN 'base' ELSE 'user-v' || max(version) END AS model, 'models/user_' || u.user_id || '/v' || max(version) AS path
FROM (SELECT DISTINCT user_id * 2 AS user_id FROM v_document) u LEFT JOIN v_user_model m ON m.user_id = u.user_id GROUP BY u.user_id""")
def model_choice(s, d):
    return R.model_choice(V.documents(s, d).select((F.col("user_id") * 2).alias("user_id")), V.user_models(s, d), "models")
