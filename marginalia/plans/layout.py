"""Layout, geometry, diversity and names over the corpus views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, text as T
from ..operators import layout as L, names as N
from ..sources import views as V
from .registry import query
from .relational import scored


@query("win6_smoothed_profile", "SELECT page_id, pos, sum(ink) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE AS smooth FROM v_profile")
def smoothed(s, d):
    return L.smoothed(V.profiles(s, d)).select("page_id", "pos", "smooth")


ISLANDS_SQL = """top AS (SELECT page_id, greatest(max(ink) * 0.02::DOUBLE, 1.0::DOUBLE) AS threshold, count(*) AS height FROM v_profile GROUP BY 1),
marked AS (SELECT p.page_id, p.pos, t.height, p.pos - lag(p.pos) OVER (PARTITION BY p.page_id ORDER BY p.pos) - 1 AS gap FROM v_profile p JOIN top t USING (page_id) WHERE p.ink >= t.threshold),
numbered AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= greatest(height // 200, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM marked),
islands AS (SELECT page_id, height, min(pos) AS start, max(pos) + 1 AS stop FROM numbered GROUP BY page_id, height, island)"""


@query("win4_ink_islands", f"WITH {ISLANDS_SQL} SELECT page_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM islands")
def islands(s, d):
    return L.islands(V.profiles(s, d)).select("page_id", "start", "stop")


@query("img2_line_segments", f"""WITH {ISLANDS_SQL},
padded AS (SELECT page_id, height, greatest(start - greatest(height // 200, 2), 0) AS y0, least(stop + greatest(height // 200, 2), height) AS y1, count(*) OVER (PARTITION BY page_id) AS n FROM islands),
whole AS (SELECT page_id, count(*) AS height FROM v_profile GROUP BY 1)
SELECT page_id, CAST(y0 AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1 FROM padded WHERE NOT (n = 1 AND y1 - y0 > height * 0.6::DOUBLE)
UNION ALL SELECT page_id, y AS y0, least(y + greatest(CAST(floor(height * 0.035::DOUBLE) AS BIGINT), 40), height) AS y1 FROM (SELECT page_id, height, unnest(range(0, height, greatest(CAST(floor(height * 0.035::DOUBLE) AS BIGINT), 40))) AS y FROM padded WHERE n = 1 AND y1 - y0 > height * 0.6::DOUBLE)
UNION ALL SELECT page_id, 0, height FROM whole WHERE page_id NOT IN (SELECT page_id FROM islands)""")
def segments(s, d):
    return L.line_segments(V.profiles(s, d))


# The next page's profile stands for the page's columns.
BOUNDS_SQL = """axes AS (SELECT page_id, 'y' AS axis, pos, ink FROM v_profile UNION ALL SELECT page_id - 1, 'x', pos, ink FROM v_profile),
t AS (SELECT page_id, axis, greatest(max(ink) * 0.01::DOUBLE, 1.0::DOUBLE) AS least_, count(*) AS size FROM axes GROUP BY 1, 2),
e AS (SELECT b.page_id, b.axis, size, greatest(0, min(pos) FILTER (ink >= least_) - floor(size * 0.03::DOUBLE)) AS low, least(size, max(pos) FILTER (ink >= least_) + floor(size * 0.03::DOUBLE)) AS high FROM axes b JOIN t ON b.page_id = t.page_id AND b.axis = t.axis GROUP BY 1, 2, 3),
j AS (SELECT y.page_id, x.low AS x1, x.high AS x2, y.low AS y1, y.high AS y2, (x.high - x.low) * (y.high - y.low) <= x.size * y.size * 0.9::DOUBLE AS useful FROM e x JOIN e y ON x.page_id = y.page_id AND x.axis = 'x' AND y.axis = 'y'),
bounds AS (SELECT page_id, CAST(CASE WHEN useful THEN x1 END AS BIGINT) AS x, CAST(CASE WHEN useful THEN y1 END AS BIGINT) AS y, CAST(CASE WHEN useful THEN x2 - x1 END AS BIGINT) AS w, CAST(CASE WHEN useful THEN y2 - y1 END AS BIGINT) AS h FROM j)"""


@query("img3_content_bounds", f"WITH {BOUNDS_SQL} SELECT * FROM bounds")
def bounds(s, d):
    p = V.profiles(s, d)
    return L.content_bounds(p, p.withColumn("page_id", F.col("page_id") - 1))


@query("img12_auto_crop", f"WITH {BOUNDS_SQL} SELECT page_id, coalesce(x, 0) AS crop_x, coalesce(y, 0) AS crop_y, coalesce(w, 64) AS crop_w, coalesce(h, 64) AS crop_h FROM bounds")
def auto_crop(s, d):
    whole = {"x": 0, "y": 0, "w": 64, "h": 64}
    return bounds(s, d).select("page_id", *[F.coalesce(c, F.lit(v).cast("long")).alias(f"crop_{c}") for c, v in whole.items()])


@query("img11_row_projection", "SELECT page_id, sum(ink) AS total, max(ink) AS top FROM v_profile GROUP BY 1")
def projection(s, d):
    return V.profiles(s, d).groupBy("page_id").agg(F.sum("ink").alias("total"), F.max("ink").alias("top"))


@query("img7_margin_notes", """WITH sized AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS size FROM v_profile), sides AS (SELECT page_id, ink, CASE WHEN pos < greatest(size // 8, 1) THEN 'left' WHEN pos >= size - greatest(size // 8, 1) THEN 'right' END AS side FROM sized)
SELECT page_id, side, least(0.95::DOUBLE, avg(CASE WHEN ink > 200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 4) AS score FROM sides WHERE side IS NOT NULL GROUP BY 1, 2 HAVING avg(CASE WHEN ink > 200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.12::DOUBLE""")
def margins(s, d):
    return L.margin_notes(V.profiles(s, d))


@query("win7_autocorrelation", """WITH c AS (SELECT page_id, pos, ink - avg(ink) OVER (PARTITION BY page_id) AS v FROM v_profile), pw AS (SELECT page_id, sum(v * v) AS power FROM c GROUP BY 1),
r AS (SELECT a.page_id, b.pos - a.pos AS lag, sum(a.v * b.v) / any_value(power) AS r FROM c a JOIN c b ON a.page_id = b.page_id AND b.pos - a.pos BETWEEN 2 AND 21 JOIN pw ON pw.page_id = a.page_id GROUP BY 1, 2),
n AS (SELECT *, lag(r) OVER (PARTITION BY page_id ORDER BY lag) AS before_, lead(r) OVER (PARTITION BY page_id ORDER BY lag) AS after_ FROM r)
SELECT page_id, CAST(min(lag) AS INTEGER) AS lag FROM n WHERE r > 0.3::DOUBLE AND r > before_ AND r >= after_ AND lag BETWEEN 3 AND 20 GROUP BY 1""")
def autocorrelation(s, d):
    return L.autocorrelation_peak(V.profiles(s, d), 3, 20)


STROKES_SQL = "strokes AS (SELECT page_id, x + 5 AS sx, CAST(y + h // 2 - 2 + n % 9 AS INTEGER) AS sy, CAST(w * (n % 4 + 1) // 4 AS INTEGER) AS sw, CAST(n % 12 + 1 AS INTEGER) AS sh FROM v_result)"


@query("img6_strike_through", f"""WITH {STROKES_SQL} SELECT v.id, bool_or(s.sx IS NOT NULL) AS struck FROM v_result v LEFT JOIN strokes s ON v.page_id = s.page_id AND v.w >= 24 AND v.h >= 10 AND s.sw >= 0.55::DOUBLE * v.w
AND s.sw >= greatest(32.0::DOUBLE, 0.45::DOUBLE * v.w) AND s.sh <= greatest(8.0::DOUBLE, 0.30::DOUBLE * v.h) AND abs(s.sy + s.sh / 2.0::DOUBLE - (v.y + v.h / 2.0::DOUBLE)) <= 0.18::DOUBLE * v.h
AND least(v.x + v.w, s.sx + s.sw) - greatest(v.x, s.sx) >= 0.5::DOUBLE * v.w GROUP BY 1""")
def strikes(s, d):
    r, n = V.results(s, d), F.col("n")
    strokes = r.select("page_id", (F.col("x") + 5).alias("sx"), (F.col("y") + F.floor(F.col("h") / 2) - 2 + n % 9).cast("int").alias("sy"), F.floor(F.col("w") * (n % 4 + 1) / 4).cast("int").alias("sw"), (n % 12 + 1).cast("int").alias("sh"))
    return L.strike_through(r, strokes)


# Lines of a page of 1000 x 750, a little askew: arrows and underlines lie, tables and circles stand.
QUAD_SQL = """WITH l AS (SELECT page_id, id AS line_id, element_type IN ('arrow', 'underline') AS horizontal, CASE WHEN element_type IN ('arrow', 'underline') THEN 100 ELSE x END AS x1, CASE WHEN element_type IN ('arrow', 'underline') THEN y ELSE 80 END AS y1,
  CASE WHEN element_type IN ('arrow', 'underline') THEN 900 ELSE x + id % 7 END AS x2, CASE WHEN element_type IN ('arrow', 'underline') THEN y + id % 5 ELSE 660 END AS y2 FROM v_visual WHERE element_type <> 'box' AND id % 8 = 0),
i AS (SELECT * FROM l WHERE least(x1, x2) > 60 AND greatest(x1, x2) < 940 AND least(y1, y2) > 45 AND greatest(y1, y2) < 705),
tall AS (SELECT a.page_id, a AS t, b AS b FROM i a JOIN i b ON a.page_id = b.page_id AND a.horizontal AND b.horizontal AND (b.y1 + b.y2) / 2.0::DOUBLE > (a.y1 + a.y2) / 2.0::DOUBLE + 75),
wide AS (SELECT a.page_id, a AS l, b AS r FROM i a JOIN i b ON a.page_id = b.page_id AND NOT a.horizontal AND NOT b.horizontal AND (b.x1 + b.x2) / 2.0::DOUBLE > (a.x1 + a.x2) / 2.0::DOUBLE + 200),
q AS (SELECT tall.page_id, t, b, l, r, {corners} FROM tall JOIN wide ON tall.page_id = wide.page_id),
z AS (SELECT *, (sqrt((tlx - trx) * (tlx - trx) + (tly - try_) * (tly - try_)) + sqrt((blx - brx) * (blx - brx) + (bly - bry) * (bly - bry))) / 2.0::DOUBLE AS qw,
  (sqrt((tlx - blx) * (tlx - blx) + (tly - bly) * (tly - bly)) + sqrt((trx - brx) * (trx - brx) + (try_ - bry) * (try_ - bry))) / 2.0::DOUBLE AS qh, ((tlx + trx + brx + blx) / 4.0::DOUBLE - 500) / 1000.0::DOUBLE AS dx, ((tly + try_ + bry + bly) / 4.0::DOUBLE - 375) / 750.0::DOUBLE AS dy FROM q
  WHERE least(tlx, trx, brx, blx) >= 60 AND greatest(tlx, trx, brx, blx) <= 940 AND least(tly, try_, bry, bly) >= 45 AND greatest(tly, try_, bry, bly) <= 705),
s AS (SELECT *, least(2.0::DOUBLE, qw / 1000) + least(1.2::DOUBLE, qh / 750) - sqrt(dx * dx + dy * dy) * 1.8::DOUBLE + least(0.8::DOUBLE, qw / greatest(qh, 1.0::DOUBLE) * 0.12::DOUBLE) AS score FROM z
  WHERE qh > 0 AND qw / qh >= 1.1::DOUBLE AND qw >= 350 AND qh >= 112.5::DOUBLE AND sqrt(dx * dx + dy * dy) <= 0.55::DOUBLE)
SELECT page_id, t.line_id AS top, b.line_id AS bottom, l.line_id AS "left", r.line_id AS "right", CAST(floor(score * 1000 + 0.5::DOUBLE) AS BIGINT) AS permille FROM s WHERE score > -1
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, t.line_id, b.line_id, l.line_id, r.line_id) = 1"""


def _corner(name: str, a: str, b: str) -> str:
    den = f"(({a}.x1 - {a}.x2) * ({b}.y1 - {b}.y2) - ({a}.y1 - {a}.y2) * ({b}.x1 - {b}.x2))::DOUBLE"
    both = lambda p: f"(({a}.x1 * {a}.y2 - {a}.y1 * {a}.x2) * ({b}.{p}1 - {b}.{p}2) - ({a}.{p}1 - {a}.{p}2) * ({b}.x1 * {b}.y2 - {b}.y1 * {b}.x2))::DOUBLE / {den}"
    return f"{both('x')} AS {name}x, {both('y')} AS {'try_' if name == 'tr' else name + 'y'}"


@query("jn13_best_quad", QUAD_SQL.replace("{corners}", ", ".join(_corner(*c) for c in (("tl", "t", "l"), ("tr", "t", "r"), ("br", "b", "r"), ("bl", "b", "l")))))
def quads(s, d):
    h, i = F.col("element_type").isin("arrow", "underline"), F.col("id")
    found = V.visuals(s, d).where((F.col("element_type") != "box") & (i % 8 == 0)).select(
        "page_id", i.alias("line_id"), h.alias("horizontal"), F.when(h, 100).otherwise(F.col("x")).alias("x1"), F.when(h, F.col("y")).otherwise(80).alias("y1"),
        F.when(h, 900).otherwise(F.col("x") + i % 7).alias("x2"), F.when(h, F.col("y") + i % 5).otherwise(660).alias("y2"),
    )
    out = L.best_quad(found, 1000, 750, (500.0, 375.0))
    return out.select("page_id", "top", "bottom", "left", "right", F.floor(F.col("score") * 1000 + 0.5).alias("permille"))


@query("geo4_snapped_lines", """WITH e AS (SELECT id, element_type, w, h, id % 3 AS n FROM v_visual), c AS (SELECT id, k, id % 50 AS x1, (id * k) % 40 AS y1, id % 50 + (id * 7 * k) % 90 AS x2, (id * k) % 40 + (id % 11) * k AS y2 FROM v_visual, (SELECT unnest([1, 2, 3]) AS k)),
m AS (SELECT c.*, e.element_type, e.w, e.h, e.n, sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) AS len, abs(degrees(atan2((y2 - y1)::DOUBLE, (x2 - x1)::DOUBLE))) AS angle FROM c JOIN e USING (id) WHERE e.element_type IN ('arrow', 'underline')),
b AS (SELECT * FROM m WHERE element_type <> 'underline' OR angle <= 25 OR angle >= 155 QUALIFY row_number() OVER (PARTITION BY id ORDER BY len DESC, x1, y1, x2, y2) = 1),
t AS (SELECT id, x1 || ' ' || y1 || ' ' || x2 || ' ' || y2 AS path FROM b WHERE len >= greatest(12.0::DOUBLE, 0.45::DOUBLE * greatest(w, h)) AND (element_type = 'underline' OR n < 2))
SELECT e.id, coalesce(t.path, CASE e.n WHEN 0 THEN '' WHEN 1 THEN '1 2' ELSE '1 2 3 4' END) AS path FROM e LEFT JOIN t USING (id)""")
def snapped(s, d):
    i, v = F.col("id"), V.visuals(s, d)
    points = F.slice(F.array(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.array(F.lit(3).cast("long"), F.lit(4).cast("long"))), F.lit(1), (i % 3).cast("int"))
    lines = v.select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    k = F.col("k")
    lines = lines.select("id", (i % 50).alias("x1"), ((i * k) % 40).alias("y1"), (i % 50 + (i * 7 * k) % 90).alias("x2"), ((i * k) % 40 + (i % 11) * k).alias("y2"))
    out = L.snapped(v.select("id", "element_type", "w", "h", points.alias("points")), lines)
    return out.select("id", F.array_join(F.transform(F.flatten("points"), lambda x: x.cast("string")), " ").alias("path"))


@query("geo9_skew_angle", """WITH a AS (SELECT page_id, (id % 61 - 30) / 2.0::DOUBLE AS a FROM v_visual), m AS (SELECT page_id, count(*) AS n, quantile_cont(a, 0.5) AS m FROM a WHERE abs(a) < 15 GROUP BY 1)
SELECT page_id, CASE WHEN n >= 5 AND abs(m) >= 0.3::DOUBLE AND abs(m) <= 10 THEN m ELSE 0.0::DOUBLE END AS angle FROM m""")
def skew(s, d):
    return L.skew_angle(V.visuals(s, d), (F.col("id") % 61 - 30) / 2.0)


@query("geo1_pixel_boxes", """SELECT id, CAST(least(greatest(CAST(trunc(x * 1240 / 1000.0::DOUBLE) AS INTEGER), 0), 1239) AS INTEGER) AS px, CAST(least(greatest(CAST(trunc(y * 1754 / 1000.0::DOUBLE) AS INTEGER), 0), 1753) AS INTEGER) AS py,
CAST(greatest(5, CAST(trunc((x + w) * 1240 / 1000.0::DOUBLE) AS INTEGER) - least(greatest(CAST(trunc(x * 1240 / 1000.0::DOUBLE) AS INTEGER), 0), 1239)) AS INTEGER) AS pw,
CAST(greatest(1, CAST(trunc((y + h) * 1754 / 1000.0::DOUBLE) AS INTEGER) - least(greatest(CAST(trunc(y * 1754 / 1000.0::DOUBLE) AS INTEGER), 0), 1753)) AS INTEGER) AS ph FROM v_visual""")
def pixel_boxes(s, d):
    c = F.col
    return V.visuals(s, d).select("id", *[v.alias(k) for k, v in G.to_pixels(c("y"), c("x"), c("y") + c("h"), c("x") + c("w"), F.lit(1240), F.lit(1754), 5).items()])


@query("geo2_pushed_corners", "SELECT id, CAST(least(greatest(CAST(trunc(x + (x - 450.0::DOUBLE) * 0.02::DOUBLE) AS INTEGER), 0), 899) AS INTEGER) AS corner FROM v_visual")
def corners(s, d):
    return V.visuals(s, d).select("id", G.pushed_out(F.col("x"), F.lit(450.0), F.lit(900)).alias("corner"))


@query("geo3_geometry_points", """SELECT id, CAST(x * 2 + w * 2 - x * 2 AS INTEGER) AS dx, CAST(h * 2 AS INTEGER) AS dy, greatest(1, CAST(json_extract(geometry, '$.k') AS INTEGER)) AS row_count FROM v_visual""")
def geometry_points(s, d):
    points = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + F.col("w")).alias("x"), (F.col("y") + F.col("h")).alias("y")))
    scaled = F.transform(points, lambda p: F.struct((p["x"] * 2).alias("x"), (p["y"] * 2).alias("y")))
    read = F.from_json("geometry", "k int")
    rows = V.visuals(s, d).select("id", scaled.alias("p"), F.greatest(F.lit(1), read["k"]).alias("row_count"))
    last, before = F.element_at("p", -1), F.element_at("p", -2)
    return rows.select("id", (last["x"] - before["x"]).alias("dx"), (last["y"] - before["y"]).alias("dy"), "row_count")


@query("geo5_placement", "SELECT id, x / 900.0::DOUBLE * 100 AS left_percent, least(greatest(h * 0.72::DOUBLE, 10.0::DOUBLE), 22.0::DOUBLE) AS font FROM v_visual")
def placement(s, d):
    return V.visuals(s, d).select("id", (F.col("x") / 900.0 * 100).alias("left_percent"), G.font_size(F.col("h")).alias("font"))


@query("geo6_img13_crop_offset", "SELECT id, x + 17 AS page_x, y + 29 AS page_y, w, h FROM v_visual")
def crop_offset(s, d):
    return V.visuals(s, d).select("id", (F.col("x") + 17).alias("page_x"), (F.col("y") + 29).alias("page_y"), "w", "h")


@query("geo7_latest_box", "SELECT page_id, arg_max(x, id) AS x, arg_max(y, id) AS y FROM v_visual GROUP BY 1")
def latest_box(s, d):
    return V.visuals(s, d).groupBy("page_id").agg(F.max_by("x", "id").alias("x"), F.max_by("y", "id").alias("y"))


@query("geo8_warp_size", "SELECT id, CAST(floor(sqrt((w * 10.0::DOUBLE) * (w * 10.0::DOUBLE) + h * h::DOUBLE)) AS INTEGER) AS width, floor(sqrt((w * 10.0::DOUBLE) * (w * 10.0::DOUBLE) + h * h::DOUBLE)) >= 100 AS usable FROM v_visual")
def warp_size(s, d):
    side = G.side(F.col("w") * 10.0, F.col("h").cast("double"), F.lit(0.0), F.lit(0.0))
    return V.visuals(s, d).select("id", F.floor(side).cast("int").alias("width"), (F.floor(side) >= 100).alias("usable"))


@query("img15_region_json", "SELECT id, element_type AS label, CAST(x AS BIGINT) AS x FROM v_visual")
def region_json(s, d):
    made = V.visuals(s, d).select("id", F.to_json(F.struct(F.col("element_type").alias("label"), F.array("x", "y", "w", "h").alias("bbox"))).alias("j"))
    return made.select("id", F.get_json_object("j", "$.label").alias("label"), F.get_json_object("j", "$.bbox[0]").cast("long").alias("x"))


@query("jn11_img5_ordered_match", """WITH RECURSIVE texts AS MATERIALIZED (SELECT page_id, n % 20 AS i, (y + 20)::DOUBLE AS gy, row_number() OVER (PARTITION BY page_id ORDER BY y, n % 20) AS k FROM v_result),
inks AS (SELECT page_id, n % 20 AS j, (y + 24)::DOUBLE AS center, CASE WHEN n % 13 = 0 THEN 200.0::DOUBLE ELSE 40.0::DOUBLE END AS height FROM v_result WHERE n % 5 <> 3),
usual AS (SELECT page_id, list(height ORDER BY height)[count(*) // 2 + 1] AS high FROM inks GROUP BY 1),
kept AS (SELECT *, center - lag(center) OVER (PARTITION BY page_id ORDER BY center, j) AS gap FROM inks JOIN usual USING (page_id) WHERE height <= 2.5::DOUBLE * high),
lists AS MATERIALIZED (SELECT page_id, list({'c': center, 'j': j} ORDER BY center, j) AS ls, 2 * floor(1.5::DOUBLE * coalesce((list(gap ORDER BY gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1], 40.0::DOUBLE)) AS reach FROM kept GROUP BY 1),
tried(page_id, k, next_, i, j) AS (SELECT page_id, 0::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT page_id FROM texts)
  UNION ALL SELECT p.page_id, t.k, p.next_ + CASE WHEN abs(t.gy - l.ls[p.next_].c) < l.reach THEN 1 ELSE 0 END, t.i, CASE WHEN abs(t.gy - l.ls[p.next_].c) < l.reach THEN l.ls[p.next_].j END
  FROM tried p JOIN texts t ON t.page_id = p.page_id AND t.k = p.k + 1 LEFT JOIN lists l ON l.page_id = p.page_id)
SELECT page_id, i, j FROM tried WHERE k > 0""")
def ordered_match(s, d):
    r = V.results(s, d)
    texts = r.select("page_id", (F.col("n") % 20).alias("i"), (F.col("y") + 20).cast("double").alias("gy"))
    inks = r.where(F.col("n") % 5 != 3).select("page_id", (F.col("n") % 20).alias("j"), (F.col("y") + 24).cast("double").alias("center"), F.when(F.col("n") % 13 == 0, 200.0).otherwise(40.0).alias("height"))
    return L.match_ordered(texts, inks)


# Of each page of 1240 x 1000, lines 3, 8, 13 and those from 15 on lie on no ink, every seventh has no box, and page 0 of a document has no ink.
@query("img5_line_boxes", """WITH l AS (SELECT page_id, n % 20 AS i, CASE WHEN n % 7 <> 6 THEN y END AS y1, CASE WHEN n % 7 <> 6 THEN x END AS x1, CASE WHEN n % 7 <> 6 THEN least(1000, x + w) END AS x2,
  CASE WHEN n % 5 <> 3 AND n % 20 < 15 AND page_id % 1000 <> 0 THEN y + 4 END AS top, CASE WHEN n % 5 <> 3 AND n % 20 < 15 AND page_id % 1000 <> 0 THEN 30 + n % 9 END AS height FROM v_result),
w AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, max(CASE WHEN top IS NOT NULL THEN i END) OVER (PARTITION BY page_id) AS last_ FROM l),
v AS (SELECT *, max(CASE WHEN i = last_ THEN top END) OVER (PARTITION BY page_id) AS last_top, 1000 / (n + 1)::DOUBLE AS spacing, top IS NULL AND coalesce(i > last_, false) AS after_ FROM w),
b AS (SELECT page_id, i, CASE WHEN x1 IS NULL THEN 0 ELSE greatest(0, CAST(trunc(x1 / 1000.0::DOUBLE * 1240) AS BIGINT)) END AS x, CASE WHEN x1 IS NULL THEN 1240 ELSE greatest(5, least(1240, CAST(trunc(x2 / 1000.0::DOUBLE * 1240) AS BIGINT)) - greatest(0, CAST(trunc(x1 / 1000.0::DOUBLE * 1240) AS BIGINT))) END AS w,
  CASE WHEN x1 IS NULL THEN CAST(trunc(i * spacing) AS BIGINT) WHEN after_ THEN last_top + (i - last_) * 48 ELSE coalesce(top, greatest(0, CAST(trunc(y1 / 1000.0::DOUBLE * 1000) AS BIGINT))) END AS y,
  CASE WHEN x1 IS NULL THEN CAST(trunc(spacing) AS BIGINT) WHEN after_ THEN 34 ELSE coalesce(height, CASE WHEN page_id % 1000 <> 0 THEN 34 END, 80) END AS h FROM v)
SELECT page_id, i, CAST(x AS BIGINT) AS x, CAST(greatest(0, least(y, 1000 - h)) AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM b""")
def line_boxes(s, d):
    r, n = V.results(s, d), F.col("n")
    boxed = lambda v: F.when(n % 7 != 6, v)
    lines = r.select("page_id", (n % 20).alias("i"), boxed(F.col("y")).alias("y1"), boxed(F.col("x")).alias("x1"), boxed(F.col("y") + 40).alias("y2"), boxed(F.least(F.lit(1000), F.col("x") + F.col("w"))).alias("x2"))
    inked = r.where((n % 5 != 3) & (n % 20 < 15) & (F.col("page_id") % 1000 != 0)).select("page_id", (n % 20).alias("i"), (F.col("y") + 4).alias("top"), (30 + n % 9).alias("height"))
    ink = F.col("page_id") % 1000 != 0
    pages = r.select("page_id").distinct().select("page_id", F.lit(1240).alias("page_w"), F.lit(1000).alias("page_h"), F.when(ink, 48).alias("spacing"), F.when(ink, 34).alias("ink_height"))
    return L.line_boxes(lines, inked, pages)


@query("win3_diverse_selection")
def diverse(s, d):
    users = V.documents(s, d).select(F.col("id").alias("document_id"), F.col("user_id").cast("long").alias("group"))
    return L.diverse(scored(s, d).join(users, "document_id").select("group", "id", "text", "score"), 10)


@query("win3_bigram_jaccard", """WITH w AS (SELECT id, lower(trim(text)) AS a, lower(trim(lead(text) OVER (PARTITION BY document_id ORDER BY n))) AS b FROM v_result),
g AS (SELECT id, CASE WHEN length(a) < 2 THEN list_value(a) ELSE list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) END AS x, CASE WHEN length(b) < 2 THEN list_value(b) ELSE list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) END AS y FROM w WHERE b IS NOT NULL)
SELECT id, len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE AS jaccard FROM g""")
def jaccard(s, d):
    from pyspark.sql import Window

    following = F.lead("text").over(Window.partitionBy("document_id").orderBy("n"))
    rows = V.results(s, d).withColumn("b", following).where("b is not null")
    return rows.select("id", T.jaccard(T.bigrams(F.col("text")), T.bigrams(F.col("b"))).alias("jaccard"))


# Lower case stands for a translation; a name's case is kept wherever it stands, and the fallback translates what the first provider refuses.
@query("nam1_nam2_trn1_masked_translation", """WITH told AS (SELECT id, n, trim('Our company is called Acme' || document_id || ', with Zenith Labs: ' || text || ' at acme' || document_id) AS text, text AS line FROM v_result)
SELECT id, CASE n % 4 WHEN 1 THEN 'error' WHEN 0 THEN 'same' ELSE 'translated' END AS status,
  CASE n % 4 WHEN 1 THEN NULL WHEN 0 THEN text ELSE 'our company is called Acme' || (id // 1000) || ', with Zenith labs: ' || lower(line) || ' at Acme' || (id // 1000) END AS translated FROM told""")
def masked_translation(s, d):
    n, name = F.col("n"), F.concat(F.lit("cme"), F.col("document_id").cast("string"))
    told = F.concat(F.lit("Our company is called A"), name, F.lit(", with Zenith Labs: "), "text", F.lit(" at a"), name)
    language = F.when(n % 4 == 0, "en").when(n % 4 == 1, "mixed").when(n % 4 == 2, "ta").otherwise("hi")

    def first(text: str, source: str, _target: str) -> str:
        if source == "hi":
            raise RuntimeError("busy")
        return text.lower()

    rows = V.results(s, d).select("id", told.alias("text"), language.alias("source"))
    return N.translate(rows, first, fallback=lambda text, _source, _target: text.lower()).select("id", "status", "translated")


@query("trn2_translation_request", """WITH asked AS (SELECT id, n, trim(text) AS text FROM v_result)
SELECT id, CASE n % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'same' ELSE 'translated' END AS status, CASE n % 3 WHEN 0 THEN 'translation equals the text' END AS error FROM asked""")
def translation_request(s, d):
    """Requests in Tamil named as such, English ones to be detected, and ones that come back unchanged."""
    n = F.col("n") % 3
    rows = V.results(s, d).select("id", F.when(n == 1, F.concat(F.lit("plain english words before it "), F.col("text"))).otherwise(F.col("text")).alias("text"), F.when(n == 0, "ta").when(n == 1, "auto").otherwise("hi").alias("source"))
    out = N.translate_request(rows, lambda text, source, _target: text if source == "ta" else text + "!")
    return out.select("id", "status", "error")
