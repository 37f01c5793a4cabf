"""Page layout from projection profiles, boxes and stroke tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


#: How many times the asked number of items are looked at first.
LOOK_AHEAD = 16


def smoothed(profile: DataFrame) -> DataFrame:
    """Mean of three neighbours with zeros beyond the edges, as ``smooth``."""
    near = Window.partitionBy("page_id").orderBy("pos").rowsBetween(-1, 1)
    return profile.withColumn("smooth", F.sum("ink").over(near) / 3.0)


def islands(profile: DataFrame, share: float = 0.02, value: str = "ink") -> DataFrame:
    """page_id, start, stop, height: runs of rows at or above a share of the page's maximum (1 at least), close runs merged.

    Runs of marked rows are told apart by the gap to the marked row before; a
    gap below max(0.5 % of the height, 3) joins them.
    """
    top = profile.groupBy("page_id").agg(F.greatest(F.max(value) * share, F.lit(1.0)).alias("threshold"), F.count("*").alias("height"))
    marked = profile.join(top, "page_id").where(F.col(value) >= F.col("threshold"))
    order = Window.partitionBy("page_id").orderBy("pos")
    least_gap = F.greatest(F.floor(F.col("height") * 0.005), F.lit(3))
    gap = F.col("pos") - F.lag("pos").over(order) - 1
    starts = marked.withColumn("new", F.when(gap.isNull() | (gap >= least_gap), 1).otherwise(0))
    grouped = starts.withColumn("island", F.sum("new").over(order))
    return grouped.groupBy("page_id", "island", "height").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).drop("island")


def line_segments(profile: DataFrame) -> DataFrame:
    """page_id, y0, y1 of text lines, padded; a page without any is one segment, one of a single tall segment is cut into strips."""
    found = islands(profile)
    pad = F.greatest(F.floor(F.col("height") * 0.005), F.lit(2))
    padded = found.select("page_id", "height", F.greatest(F.col("start") - pad, F.lit(0)).alias("y0"), F.least(F.col("stop") + pad, F.col("height")).alias("y1"))
    counted = padded.withColumn("n", F.count("*").over(Window.partitionBy("page_id")))
    tall = (F.col("n") == 1) & (F.col("y1") - F.col("y0") > F.col("height") * 0.6)
    strip = F.greatest(F.floor(F.col("height") * 0.035), F.lit(40))
    cuts = F.when(tall, F.transform(F.sequence(F.lit(0).cast("long"), F.col("height") - 1, strip), lambda y: F.struct(y.alias("y0"), F.least(y + strip, F.col("height")).alias("y1")))).otherwise(
        F.array(F.struct(F.col("y0").cast("long").alias("y0"), F.col("y1").cast("long").alias("y1"))))
    lines = counted.select("page_id", F.explode(cuts).alias("c")).select("page_id", "c.y0", "c.y1")
    empty = profile.groupBy("page_id").agg(F.count("*").alias("y1")).join(found.select("page_id").distinct(), "page_id", "left_anti")
    return lines.unionByName(empty.select("page_id", F.lit(0).cast("long").alias("y0"), "y1"))


def content_bounds(rows: DataFrame, columns: DataFrame, share: float = 0.01, pad: float = 0.03, most: float = 0.9) -> DataFrame:
    """page_id, x, y, w, h of a page's content, padded; null where its area is more than 90 % of the page's, or there is none.

    ``rows`` and ``columns`` are the page's two profiles (page_id, pos, ink).
    """
    def edges(profile: DataFrame, low: str, high: str, size: str) -> DataFrame:
        top = profile.groupBy("page_id").agg(F.greatest(F.max("ink") * share, F.lit(1.0)).alias("threshold"), F.count("*").alias(size))
        inside = F.when(F.col("ink") >= F.col("threshold"), F.col("pos"))
        found = profile.join(top, "page_id").groupBy("page_id", size).agg(F.min(inside).alias("first"), F.max(inside).alias("last"))
        padding = F.floor(F.col(size) * pad)
        return found.select("page_id", size, F.greatest(F.lit(0), F.col("first") - padding).alias(low), F.least(F.col(size), F.col("last") + padding).alias(high))

    both = edges(rows, "y", "y2", "height").join(edges(columns, "x", "x2", "width"), "page_id")
    useful = (F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y")) <= F.col("width") * F.col("height") * most
    box = {"x": F.col("x"), "y": F.col("y"), "w": F.col("x2") - F.col("x"), "h": F.col("y2") - F.col("y")}
    return both.select("page_id", *[F.when(useful, v).cast("long").alias(k) for k, v in box.items()])


def autocorrelation_peak(profile: DataFrame, first: int, last: int, least: float = 0.3) -> DataFrame:
    """page_id, lag: the first lag in the range whose autocorrelation is a local maximum above ``least``."""
    mean = F.avg("ink").over(Window.partitionBy("page_id"))
    centered = profile.withColumn("v", F.col("ink") - mean).select("page_id", "pos", "v")
    power = centered.groupBy("page_id").agg(F.sum(F.col("v") * F.col("v")).alias("power"))
    lagged = centered.withColumn("lag", F.explode(F.sequence(F.lit(first - 1), F.lit(last + 1)))).withColumn("at", F.col("pos") + F.col("lag"))
    other = centered.select("page_id", F.col("pos").alias("at"), F.col("v").alias("u"))
    sums = lagged.join(other, ["page_id", "at"]).groupBy("page_id", "lag").agg(F.sum(F.col("v") * F.col("u")).alias("s")).join(power, "page_id")
    r = sums.withColumn("r", F.col("s") / F.nullif("power", F.lit(0.0)))
    order = Window.partitionBy("page_id").orderBy("lag")
    peaks = r.withColumns({"before": F.lag("r").over(order), "after": F.lead("r").over(order)})
    peaks = peaks.where((F.col("r") > least) & (F.col("r") > F.col("before")) & (F.col("r") >= F.col("after")) & F.col("lag").between(first, last))
    return peaks.groupBy("page_id").agg(F.min("lag").alias("lag"))


def margin_notes(profile: DataFrame) -> DataFrame:
    """page_id, side, score: the outer eighth of a column profile on either side, where more than 12 % of it is dark."""
    size = F.count("*").over(Window.partitionBy("page_id"))
    edge = F.greatest(F.floor(F.col("size") / 8), F.lit(1))
    side = F.when(F.col("pos") < edge, "left").when(F.col("pos") >= F.col("size") - edge, "right")
    dark = F.avg(F.when(F.col("ink") > 200, 1.0).otherwise(0.0))
    out = profile.withColumn("size", size).withColumn("side", side).where("side is not null").groupBy("page_id", "side").agg(dark.alias("density"))
    return out.where("density > 0.12").select("page_id", "side", F.least(F.lit(0.95), F.col("density") * 4).alias("score"))


def strike_through(boxes: DataFrame, strokes: DataFrame) -> DataFrame:
    """Boxes' ids with whether a long, thin, centered horizontal stroke crosses them. ``strokes``: page_id, sx, sy, sw, sh."""
    c = F.col
    overlap = F.least(c("x") + c("w"), c("sx") + c("sw")) - F.greatest("x", "sx")
    off = F.abs(c("sy") + c("sh") / 2.0 - (c("y") + c("h") / 2.0))
    hit = (
        (c("w") >= 24) & (c("h") >= 10) & (c("sw") >= 0.55 * c("w")) & (c("sw") >= F.greatest(F.lit(32.0), 0.45 * c("w"))) & (c("sh") <= F.greatest(F.lit(8.0), 0.30 * c("h")))
        & (off <= 0.18 * c("h")) & (overlap >= 0.5 * c("w"))
    )
    struck = boxes.join(strokes, "page_id").where(hit).select("id").distinct().withColumn("struck", F.lit(True))
    return boxes.select("id").join(struck, "id", "left").select("id", F.coalesce("struck", F.lit(False)).alias("struck"))


def _crossing(a: str, b: str) -> tuple[Column, Column]:
    """Where two lines, given as structs of two points, meet."""
    one, two = (lambda k: F.col(f"{a}.{k}").cast("double")), (lambda k: F.col(f"{b}.{k}").cast("double"))
    det = lambda line: line("x1") * line("y2") - line("y1") * line("x2")
    den = (one("x1") - one("x2")) * (two("y1") - two("y2")) - (one("y1") - one("y2")) * (two("x1") - two("x2"))
    along = lambda p, q: F.when(F.abs(den) >= 1e-6, (det(one) * (two(p) - two(q)) - (one(p) - one(q)) * det(two)) / den)
    return along("x1", "x2"), along("y1", "y2")


def best_quad(lines: DataFrame, width: int, height: int, center: tuple[float, float]) -> DataFrame:
    """page_id, top, bottom, left, right (ids of lines) and score: the best frame of two horizontal and two vertical lines.

    ``lines``: page_id, line_id, horizontal, x1, y1, x2, y2. Lines near the
    page's edges are borders; frames must be wide enough, wider than tall and
    near the expected center; among equal scores the smallest ids win. A page's
    lines are few, and frames are made page by page.
    """
    # Margins, least extents, least aspect, farthest center and the weights of the score.
    mx, my = 0.06 * width, 0.06 * height
    low = lambda a, b: F.least(F.col(a), F.col(b))
    high = lambda a, b: F.greatest(F.col(a), F.col(b))
    inner = lines.where((low("x1", "x2") > mx) & (high("x1", "x2") < width - mx) & (low("y1", "y2") > my) & (high("y1", "y2") < height - my))
    line = F.struct("line_id", "x1", "y1", "x2", "y2")
    h, v = (inner.where(F.col("horizontal") == k).select("page_id", line.alias("line")) for k in (True, False))
    pair = lambda df, a, b: df.withColumnRenamed("line", a).join(df.withColumnRenamed("line", b), "page_id")
    mid = lambda n, c: (F.col(f"{n}.{c}1") + F.col(f"{n}.{c}2")) / 2.0
    tall = pair(h, "top", "bottom").where(mid("bottom", "y") > mid("top", "y") + height * 0.10)
    wide = pair(v, "left", "right").where(mid("right", "x") > mid("left", "x") + width * 0.20)
    quads = tall.join(wide, "page_id")
    corners = {"tl": ("top", "left"), "tr": ("top", "right"), "br": ("bottom", "right"), "bl": ("bottom", "left")}
    for name, (a, b) in corners.items():
        x, y = _crossing(a, b)
        quads = quads.withColumns({f"{name}x": x, f"{name}y": y})
    quads = quads.where(" and ".join(f"{c}x between {mx} and {width - mx} and {c}y between {my} and {height - my}" for c in corners))
    far = lambda a, b: F.sqrt((F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")) + (F.col(f"{a}y") - F.col(f"{b}y")) * (F.col(f"{a}y") - F.col(f"{b}y")))
    quads = quads.withColumns({"qw": (far("tl", "tr") + far("bl", "br")) / 2.0, "qh": (far("tl", "bl") + far("tr", "br")) / 2.0})
    middle = lambda axis, at, full: (sum((F.col(f"{c}{axis}") for c in ("tr", "br", "bl")), F.col(f"tl{axis}")) / 4.0 - at) / full
    quads = quads.withColumns({"dx": middle("x", center[0], float(width)), "dy": middle("y", center[1], float(height))}).withColumn("off", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    quads = quads.where((F.col("qh") > 0) & (F.col("qw") / F.col("qh") >= 1.1) & (F.col("qw") >= width * 0.35) & (F.col("qh") >= height * 0.15) & (F.col("off") <= 0.55))
    score = F.least(F.lit(2.0), F.col("qw") / width) + F.least(F.lit(1.2), F.col("qh") / height) - F.col("off") * 1.8 + F.least(F.lit(0.8), F.col("qw") / F.greatest(F.col("qh"), F.lit(1.0)) * 0.12)
    ids = [F.col(f"{n}.line_id").alias(n) for n in ("top", "bottom", "left", "right")]
    best = quads.select("page_id", score.alias("score"), *ids).where("score > -1").groupBy("page_id").agg(F.min(F.struct((-F.col("score")).alias("back"), "top", "bottom", "left", "right")).alias("m"))
    return best.select("page_id", "m.top", "m.bottom", "m.left", "m.right", (-F.col("m.back")).alias("score"))


def snapped(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """id, points: arrows, connectors and underlines with the longest line found inside them, where that is substantial.

    ``elements``: id, element_type, w, h, points; ``lines``: id, x1, y1, x2, y2,
    found in the element's image. An underline takes only flat lines, and always;
    the others only if they have no path of their own.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sized = lines.withColumns({"length": F.hypot(dx, dy), "angle": F.abs(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))))})
    own = elements.where(F.col("element_type").isin("arrow", "connector", "underline")).select("id", "element_type", "w", "h", F.size("points").alias("n"))
    fits = sized.join(own, "id").where((F.col("element_type") != "underline") | (F.col("angle") <= 25) | (F.col("angle") >= 155))
    best = fits.groupBy("id", "element_type", "w", "h", "n").agg(F.min(F.struct((-F.col("length")).alias("back"), "x1", "y1", "x2", "y2")).alias("m"))
    enough = (-F.col("m.back") >= F.greatest(F.lit(12.0), 0.45 * F.greatest("w", "h"))) & ((F.col("element_type") == "underline") | (F.col("n") < 2))
    new = best.where(enough).select("id", F.array(F.array("m.x1", "m.y1"), F.array("m.x2", "m.y2")).alias("snapped"))
    return elements.join(new, "id", "left").select("id", F.coalesce("snapped", "points").alias("points"))


def skew_angle(lines: DataFrame, angle: Column) -> DataFrame:
    """page_id, angle: the median of the small angles, if there are five and it is neither negligible nor large."""
    small = lines.withColumn("a", angle).where(F.abs("a") < 15)
    found = small.groupBy("page_id").agg(F.count("*").alias("n"), F.percentile("a", 0.5).alias("m"))
    return found.select("page_id", F.when((F.col("n") >= 5) & (F.abs("m") >= 0.3) & (F.abs("m") <= 10), F.col("m")).otherwise(0.0).alias("angle"))


def match_ordered(texts: DataFrame, inks: DataFrame) -> DataFrame:
    """page_id, i, j: text lines (page_id, i, gy) matched in order to ink lines (page_id, j, center, height), each used once; null where none is near enough.

    Ink lines more than 2.5 times as high as the page's median are blobs and
    skipped; a pair is near if its centers lie within twice 1.5 of the median
    spacing. The pass over a page's lines is a fold over arrays inside its row.
    """
    c, at = F.col, lambda items, k: F.get(items, k)
    middle = lambda items: at(F.array_sort(items), F.floor(F.size(items) / 2).cast("int"))
    own = texts.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(c("gy").cast("double").alias("gy"), c("i").cast("long").alias("i")))).alias("texts"))
    ink = inks.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(c("center").cast("double").alias("center"), c("j").cast("long").alias("j"), c("height").cast("double").alias("height")))).alias("inks"))
    ink = ink.withColumn("high", middle(F.transform("inks", lambda x: x.height))).withColumn("inks", F.filter("inks", lambda x: x.height <= 2.5 * c("high")))
    gaps = F.transform(F.slice("inks", 2, F.greatest(F.size("inks") - 1, F.lit(0))), lambda x, k: x.center - at(c("inks"), k).center)
    ink = ink.withColumn("reach", 2 * F.floor(1.5 * F.coalesce(middle(gaps), F.lit(40.0))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i: long, j: long>>").alias("out"))

    def step(state: Column, text: Column) -> Column:
        ink_line = at(c("inks"), state["at"])
        near = F.coalesce(F.abs(text.gy - ink_line.center) < c("reach"), F.lit(False))
        return F.struct((state["at"] + near.cast("int")).alias("at"), F.concat(state["out"], F.array(F.struct(text.i.alias("i"), F.when(near, ink_line.j).alias("j")))).alias("out"))

    return own.join(ink, "page_id", "left").select("page_id", F.inline(F.aggregate("texts", start, step)["out"]))


def line_boxes(lines: DataFrame, matched: DataFrame, pages: DataFrame, usual: int = 80) -> DataFrame:
    """page_id, i, x, y, w, h of every text line, on its page.

    ``lines``: page_id, i and the recogniser's box in 0-1000 (y1, x1, y2, x2,
    null without one); ``matched``: page_id, i, top, height of lines that lie on
    ink; ``pages``: page_id, page_w, page_h, and of its ink lines the median
    spacing and ink_height (null without any). Ink decides where a line is; lines
    after the last match follow it at the median spacing; others keep the
    recogniser's place. Lines without a box are spaced evenly over the page.
    """
    c = F.col
    page = Window.partitionBy("page_id")
    rows = lines.join(pages, "page_id").join(matched, ["page_id", "i"], "left")
    rows = rows.withColumns({"n": F.count("*").over(page), "last": F.max(F.when(c("top").isNotNull(), c("i"))).over(page)})
    rows = rows.withColumn("last_top", F.max(F.when(c("i") == c("last"), c("top"))).over(page))
    after = c("top").isNull() & (c("i") > c("last"))
    pixel = lambda v, full: (c(v) / 1000.0 * c(full)).cast("long")
    left, right, own = F.greatest(F.lit(0), pixel("x1", "page_w")), F.least(c("page_w"), pixel("x2", "page_w")), F.greatest(F.lit(0), pixel("y1", "page_h"))
    spacing = c("page_h") / (c("n") + 1).cast("double")
    boxed = c("x1").isNotNull()
    found = {
        "x": F.when(boxed, left).otherwise(0), "w": F.when(boxed, F.greatest(right - left, F.lit(5))).otherwise(c("page_w")),
        "y": F.when(boxed, F.when(after, c("last_top") + (c("i") - c("last")) * c("spacing")).otherwise(F.coalesce("top", own))).otherwise((c("i") * spacing).cast("long")),
        "h": F.when(boxed, F.coalesce(F.when(after, c("ink_height")).otherwise(c("height")), "ink_height", F.lit(usual))).otherwise(spacing.cast("long")),
    }
    placed = rows.select("page_id", "i", "page_h", *[v.cast("long").alias(k) for k, v in found.items()])
    return placed.withColumn("y", F.greatest(F.lit(0), F.least("y", c("page_h") - c("h")))).select("page_id", "i", "x", "y", "w", "h")


def diverse(items: DataFrame, n: int, most: float = 0.7) -> DataFrame:
    """group, id, place: per group, the first ``n`` items by score that are not too alike, back-filled in score order.

    The pick is sequential: a group is folded in batches, in order, and stops
    once ``n`` are picked; skipped items are kept for the back-fill only as far
    as it may need them. Of each group, LOOK_AHEAD times ``n`` items are folded
    first.
    """

    def grams(text: str) -> frozenset[str]:
        t = (text or "").lower().strip()
        return frozenset(t[i : i + 2] for i in range(len(t) - 1)) if len(t) > 1 else frozenset([t])

    def fold(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, picked, skipped = None, [], []

        def close() -> pd.DataFrame:
            own = [i for i, _ in picked] + skipped[: n - len(picked)]
            return pd.DataFrame({"group": [group] * len(own), "id": own, "place": range(1, len(own) + 1), "full": [len(picked) >= n] * len(own)})

        for batch in rows:
            for g, i, text in zip(batch["group"], batch["id"], batch["text"]):
                if g != group:
                    if group is not None:
                        yield close()
                    group, picked, skipped = g, [], []
                if len(picked) >= n:
                    continue
                own = grams(text)
                if any(len(own & other) / len(own | other) > most for _, other in picked):
                    if len(skipped) < n:
                        skipped.append(i)
                else:
                    picked.append((i, own))
        if group is not None:
            yield close()

    def folded(rows: DataFrame) -> DataFrame:
        return rows.repartition("group").sortWithinPartitions("group", F.col("score").desc(), "id").mapInPandas(fold, "group long, id long, place int, full boolean")

    # The best few of a group nearly always decide; only groups that these leave short, and that have more, are folded whole.
    whole = items.select("group", "id", "text", "score")
    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.col("score").desc(), "id"))
    best = folded(whole.withColumn("nth", nth).where(F.col("nth") <= LOOK_AHEAD * n).drop("nth"))
    larger = whole.groupBy("group").count().where(F.col("count") > LOOK_AHEAD * n).select("group")
    short = best.where("not full").select("group").distinct().join(larger, "group")
    again = folded(whole.join(short, "group", "left_semi"))
    return best.join(short, "group", "left_anti").union(again).select("group", "id", "place")
