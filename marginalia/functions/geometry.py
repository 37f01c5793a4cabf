"""Boxes, points and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Space between words, in tenths of a character's width, and a character's width in them.
GAP, CHAR = 7, 10
#: Lines narrower than this are not cut into words.
LEAST_WIDTH = 40


def word_boxes(lines: DataFrame) -> DataFrame:
    """(id, x, w, text) -> id, i, word, word_x, word_w: a line's box dealt to its words by their lengths, 0.7 of a character between.

    Both ends of a word are rounded, halves to even, and its width is what lies
    between them. Narrow lines and lines of fewer than two words stay whole.
    """
    words = F.filter(F.split("text", r"(?U)\s+"), lambda t: t != "")
    cut = (F.size("ws") > 1) & (F.col("w") >= LEAST_WIDTH)
    rows = lines.withColumn("ws", words).select("id", "x", "w", cut.alias("cut"), F.posexplode(F.when(cut, F.col("ws")).otherwise(F.array(F.coalesce("text", F.lit(""))))).alias("i", "word"))
    weight = F.greatest(F.lit(1), F.length("word")) * CHAR
    line = Window.partitionBy("id")
    before = F.sum(weight + GAP).over(line.orderBy("i")) - (weight + GAP)
    total = F.sum(weight + GAP).over(line) - GAP
    share = lambda part: part * F.col("w").cast("double") / total.cast("double")
    left, right = F.bround(F.col("x") + share(before)), F.bround(F.col("x") + share(before) + share(weight))
    return rows.select(
        "id", "i", "word", F.when(F.col("cut"), left).otherwise(F.col("x")).cast("long").alias("word_x"),
        F.when(F.col("cut"), F.greatest(F.lit(1), right - left)).otherwise(F.col("w")).cast("long").alias("word_w"),
    )


def to_pixels(y1: Column, x1: Column, y2: Column, x2: Column, width: Column, height: Column, least_w: int = 1) -> dict[str, Column]:
    """A 0-1000 box, y first, as pixels inside the page, at least ``least_w`` wide and 1 high."""
    at = lambda v, full: F.least(F.greatest((v * full / 1000.0).cast("int"), F.lit(0)), full - 1)
    left, top = at(x1, width), at(y1, height)
    return {"px": left, "py": top, "pw": F.greatest(F.lit(least_w), (x2 * width / 1000.0).cast("int") - left), "ph": F.greatest(F.lit(1), (y2 * height / 1000.0).cast("int") - top)}


def pushed_out(value: Column, center: Column, full: Column, share: float = 0.02) -> Column:
    """A corner moved away from the center by a share of its distance, kept on the page."""
    return F.least(F.greatest((value + (value - center) * share).cast("int"), F.lit(0)), full - 1)


def font_size(height: Column) -> Column:
    return F.least(F.greatest(height * 0.72, F.lit(10.0)), F.lit(22.0))


def side(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)
