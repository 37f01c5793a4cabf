"""Sources, sinks and raster kernels that have no SQL, or only a part of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as RA, search as SE
from ..sources import images as I, views as V
from .registry import query


@query("src1_table_scan", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 100")
def scan(s, d):
    return V.table(s, d, "documents").where("n_chars > 100").select("doc_id", "lang", "n_chars")


@query("src2_uploaded_pages", """WITH f AS (SELECT p_partkey % 50 AS batch, '/up/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.txt' ELSE '.heic' END AS path FROM part)
SELECT batch, path, CAST(row_number() OVER (PARTITION BY batch ORDER BY path) AS INTEGER) AS page_number, regexp_replace(regexp_replace(min(path) OVER (PARTITION BY batch), '.*/', ''), '\\.[^.]*$', '') AS name FROM f WHERE NOT suffix(path, '.txt')""")
def uploads(s, d):
    k = F.col("p_partkey")
    ending = F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".jpeg").when(k % 4 == 2, ".txt").otherwise(".heic")
    files = V.table(s, d, "part").select((k % 50).alias("batch"), F.concat(F.lit("/up/"), k.cast("string"), ending).alias("path"))
    return I.uploaded_pages(files).select("batch", "path", "page_number", "name")


@query("src4_listed_images", """WITH l AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'video/mp4' ELSE 'image/png' END AS mime, CASE c_custkey % 7 WHEN 0 THEN NULL ELSE 'https://x/' || c_custkey END AS url FROM customer),
n AS (SELECT *, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS page_number FROM l WHERE mime = 'image/png') SELECT page_number, CAST(k AS VARCHAR) AS id, url FROM n WHERE url IS NOT NULL""")
def listed(s, d):
    k = F.col("c_custkey")
    listing = V.table(s, d, "customer").select(
        F.floor(k / 100).alias("page"), (k % 100).alias("place"), k.cast("string").alias("id"), F.when(k % 3 == 0, "video/mp4").otherwise("image/png").alias("mime_type"),
        F.when(k % 7 != 0, F.concat(F.lit("https://x/"), k.cast("string"))).alias("url"),
    )
    return I.listed_images(listing)


@query("snk1_index_upsert", r"""WITH t AS (SELECT id, n, unnest(regexp_extract_all(lower(CASE WHEN n % 9 = 0 THEN 'fresh words' ELSE text END), '[\pL\pN]+')) AS term FROM v_result) SELECT term, count(DISTINCT id) AS docs, count(*) AS tf FROM t GROUP BY 1""")
def index_upsert(s, d):
    r = V.results(s, d)
    fresh = SE.postings(r.where("n % 9 = 0").select("id", F.lit("fresh words").alias("text")))
    return SE.upsert_postings(SE.postings(r), fresh).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


# A stale index holds every other line; user 3's part is built anew from all of theirs.
@query("snk2_index_rebuild", r"""WITH t AS (SELECT d.user_id, r.id, r.n, unnest(regexp_extract_all(lower(r.text), '[\pL\pN]+')) AS term, len(regexp_extract_all(lower(r.text), '[\pL\pN]+')) AS length FROM v_result r JOIN v_document d ON r.document_id = d.id)
SELECT user_id, term, id, count(*) AS tf, CAST(any_value(length) AS INTEGER) AS length FROM t WHERE user_id = 3 OR n % 2 = 0 GROUP BY 1, 2, 3""")
def index_rebuild(s, d):
    users = V.documents(s, d).select(F.col("id").alias("document_id"), "user_id")
    rows = V.results(s, d).join(users, "document_id").select("user_id", "id", "n", "text")
    stale = SE.postings(rows.where("n % 2 = 0")).join(rows.select("id", "user_id"), "id")
    return SE.rebuilt(stale, rows, 3)


@query("img4_ink_lines")
def ink_lines(s, d):
    flat = V.profiles(s, d).withColumn("pos", F.col("pos") + 64 * (F.col("page_id") % 8)).withColumn("page_id", F.floor(F.col("page_id") / 8))
    return RA.ink_lines(flat)


@query("jn12_nearest_peaks", """WITH RECURSIVE lines AS MATERIALIZED (SELECT page_id, n % 20 AS i, y::DOUBLE AS at, row_number() OVER (PARTITION BY page_id ORDER BY y, n % 20) AS k FROM v_result),
places AS MATERIALIZED (SELECT page_id, list(y + 7 ORDER BY y) AS ps FROM v_result WHERE n % 4 <> 1 GROUP BY 1),
tried(page_id, k, last, i, pos) AS (SELECT page_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT page_id FROM lines)
  UNION ALL SELECT page_id, k, coalesce(pos, last), i, pos FROM (
    SELECT p.page_id, l.k, p.last, l.i, CAST((list_sort(list_transform(list_filter(s.ps, lambda q: p.last IS NULL OR q >= p.last + 20), lambda q: {'off': abs(q - l.at), 'q': q}))[1]).q AS BIGINT) AS pos
    FROM tried p JOIN lines l ON l.page_id = p.page_id AND l.k = p.k + 1 LEFT JOIN places s ON s.page_id = p.page_id))
SELECT page_id, i, pos FROM tried WHERE k > 0""")
def nearest_peaks(s, d):
    r = V.results(s, d)
    expected = r.select("page_id", (F.col("n") % 20).alias("i"), F.col("y").cast("double").alias("at"))
    peaks = r.where("n % 4 <> 1").select("page_id", (F.col("y") + 7).alias("pos"))
    return RA.nearest_peaks(expected, peaks, 20)


@query("img1_img8_binarize_rotate")
def binarize(s, d):
    return RA.profiles(RA.rotated(RA.binarized(_pixels(s, d)), 90)).where("axis = 'row'").select("page_id", "pos", "ink")


def _pixels(s, d):
    """Pages of 8 x 8 pixels: a profile's values, 255 at most."""
    flat = V.profiles(s, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ink"))).alias("v"))
    gray = F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(F.least(x["ink"], F.lit(255))), 2, "0")), ""))
    return flat.where(F.size("v") == 64).select("page_id", F.lit(8).alias("width"), F.lit(8).alias("height"), gray.alias("gray"))


# A recognizer that reads the sum of a line's pixels; the crop lies at (100, 200) of its page.
@query("img9_line_recognition", """WITH p AS (SELECT page_id, pos // 8 AS k, pos % 8 AS spot, least(ink, 255) AS v FROM v_profile)
SELECT page_id, CAST(k AS BIGINT) AS i, CAST(100 + k % 3 AS BIGINT) AS x, CAST(200 + k AS BIGINT) AS y, CAST(sum(v) FILTER (spot >= k % 3) AS VARCHAR) AS text FROM p GROUP BY page_id, k""")
def line_recognition(s, d):
    RA.register("line recognizer", lambda: lambda gray: str(int(gray.sum())))
    pages = _pixels(s, d)
    i = F.col("i")
    lines = pages.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("i"))
    lines = lines.select("page_id", "i", (i % 3).alias("x"), i.alias("y"), (8 - i % 3).alias("w"), F.lit(1).cast("long").alias("h"))
    return RA.read_lines(pages, lines, offset=(100, 200)).select("page_id", "i", "x", "y", "text")


# A photo of 3 x 2 pixels, the first letters of a nation's name, behind a JPEG header that names each orientation in turn.
@query("src6_upright_photos", """WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 8 + 1 AS o, string_split(substr(n_name || '......', 1, 6), '') AS p FROM nation)
SELECT id, CAST(CASE WHEN o < 5 THEN 3 ELSE 2 END AS INTEGER) AS width, array_to_string(list_transform(string_split(CASE o WHEN 1 THEN '123456' WHEN 2 THEN '321654' WHEN 3 THEN '654321' WHEN 4 THEN '456123' WHEN 5 THEN '142536' WHEN 6 THEN '415263' WHEN 7 THEN '635241' ELSE '362514' END, ''), lambda k: p[CAST(k AS INTEGER)]), '') AS pixels FROM n""")
def upright_photos(s, d):
    def make():
        import numpy as np

        return lambda content: np.frombuffer(content[-6:], np.uint8).reshape(2, 3)

    RA.register("decoder", make)
    # FFD8, an EXIF segment with one entry, 0112 of type 3, and the start of the image.
    header = F.concat(F.lit("FFD8" "FFE10022" "457869660000" "49492A0008000000" "0100" "12010300010000000"), (F.col("n_nationkey") % 8 + 1).cast("string"), F.lit("000000" "00000000" "FFDA"))
    content = F.concat(F.unhex(header), F.substring(F.concat("n_name", F.lit("......")), 1, 6).cast("binary"))
    images = V.table(s, d, "nation").select(F.col("n_nationkey").alias("page_id"), content.alias("content"))
    return RA.decoded(images).select(F.col("page_id").alias("id"), "width", F.col("gray").cast("string").alias("pixels"))
