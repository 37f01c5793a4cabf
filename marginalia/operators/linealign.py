"""Text lines put on the ink of their page: handwriting without ruled lines, its peaks, and lines matched to peaks in order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .strokes import by_page, opened, runs

#: The blur along a profile: rows on either side, spread, and fraction bits of its whole-number weights.
BLUR_ROWS, BLUR_SPREAD, BLUR_BITS = 7, 2.0, 16
#: Pixels between the places that a calibration tries, how far it looks, crops of one request, and the overlaps that end it and that count.
STEP, FARTHEST, AT_ONCE, ENOUGH, LEAST = 15, 150, 3, 0.5, 0.4


def weights() -> list[int]:
    """Weights of the blur, by distance."""
    raw = [math.exp(-k * k / (2 * BLUR_SPREAD**2)) for k in range(BLUR_ROWS + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [round(v / total * (1 << BLUR_BITS)) for v in raw]


def handwriting(pixels: DataFrame, width: int) -> DataFrame:
    """Ink (page_id, x, y) without ruled lines: runs of a quarter of the width, 100 pixels at least, and the rows beside them."""
    c = F.col
    ruled = opened(runs(pixels), F.lit(max(width // 4, 100)))
    ruled = ruled.withColumn("x", F.explode(F.sequence("x1", "x2"))).select("page_id", "x", F.explode(F.array(c("y") - 1, c("y"), c("y") + 1)).alias("y"))
    return pixels.join(ruled.distinct(), ["page_id", "x", "y"], "left_anti")


def handwriting_rows(found: DataFrame, width: int) -> DataFrame:
    """page_id, y, n: how many pixels :func:`handwriting` leaves of each row, from the ink's runs (page_id, y, x1, x2) alone; none for rows without any."""
    c = F.col
    ruled = opened(found, F.lit(max(width // 4, 100))).select("page_id", F.explode(F.array(c("y") - 1, c("y"), c("y") + 1)).alias("y"), "x1", "x2")
    spans = runs(ruled).groupBy("page_id", "y").agg(F.collect_list(F.struct("x1", "x2")).alias("spans"))  # of one row, few
    shared = F.aggregate("spans", F.lit(0).cast("long"), lambda n, r: n + F.greatest(F.lit(0).cast("long"), F.least(c("x2"), r["x2"]) - F.greatest(c("x1"), r["x1"]) + 1))
    size = c("x2") - c("x1") + 1
    left = found.join(spans.hint("shuffle_hash"), ["page_id", "y"], "left").select("page_id", "y", F.when(c("spans").isNull(), size).otherwise(size - shared).alias("n"))
    return left.groupBy("page_id", "y").agg(F.sum("n").alias("n")).where("n > 0")


def profile_peaks(pixels: DataFrame, height: int) -> DataFrame:
    """:func:`row_peaks` of the rows of pixels (page_id, x, y)."""
    return row_peaks(pixels.groupBy("page_id", "y").agg(F.count("*").alias("n")), height)


def row_peaks(rows: DataFrame, height: int) -> DataFrame:
    """page_id, y: local maxima of each page's blurred row counts (page_id, y, n), above 0.08 of the largest and above one pixel; mirrored at the page's ends."""
    c = F.col
    copies = F.array(c("y"), F.when(c("y") >= 1, -c("y")), F.when(c("y") <= height - 2, 2 * (height - 1) - c("y")))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights()]), (F.abs(c("k")) + 1).cast("int"))
    # All that follows works page by page.
    near = by_page(rows).withColumn("v", F.explode(copies)).where((c("v") >= -BLUR_ROWS) & (c("v") < height + BLUR_ROWS))
    spread = near.withColumn("k", F.explode(F.sequence(F.lit(-BLUR_ROWS), F.lit(BLUR_ROWS))))
    smooth = spread.select("page_id", (c("v") + c("k")).alias("y"), (c("n") * weight).alias("part")).where((c("y") >= 0) & (c("y") < height)).groupBy("page_id", "y").agg(F.sum("part").alias("p"))
    page = Window.partitionBy("page_id")
    order = page.orderBy("y")
    beside = lambda step: F.coalesce(F.when(F.lag("y", step).over(order) == c("y") - step, F.lag("p", step).over(order)), F.lit(0))
    around = smooth.select("page_id", "y", "p", beside(1).alias("before"), beside(-1).alias("after"), F.max("p").over(page).alias("most"))
    enough = (c("p") * 100 > c("most") * 8) & (c("p") > (1 << BLUR_BITS))
    return around.where(enough & (c("p") > c("before")) & (c("p") >= c("after")) & (c("y") >= 1) & (c("y") < height - 1)).select("page_id", "y")


def aligned(lines: DataFrame, peaks: DataFrame, height: int) -> DataFrame:
    """page_id, i, center of every line: the peak nearest to where it is expected, in order, each after the one before.

    ``lines``: page_id, i, center (null if the recogniser gave none); ``peaks``:
    page_id, y. Lines keep at least 0.3 of the expected spacing apart and go to
    a peak within twice of it, the upper one of two as near; without one they
    stay where they are expected. A page's lines and peaks are one array each,
    folded in order inside the row.
    """
    own = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("i", "center"))).alias("lines"))
    tops = peaks.groupBy("page_id").agg(F.sort_array(F.collect_list(F.col("y").cast("long"))).alias("peaks"))
    rows = own.join(tops, "page_id", "left").withColumn("spacing", F.lit(float(height)) / F.greatest(F.size("lines") + 2, F.lit(1)))
    least, far, step = F.greatest(F.floor(F.col("spacing") * 0.3), F.lit(10)).cast("long"), F.floor(F.col("spacing") * 2).cast("long"), F.floor("spacing").cast("long")

    def place(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        target = F.greatest(F.coalesce(line["center"].cast("long"), F.coalesce(last, F.lit(0).cast("long")) + step), last + least)  # greatest skips nulls
        begin = F.greatest(F.lit(1).cast("long"), F.coalesce(last + least, F.lit(0).cast("long")))
        near = F.filter(F.coalesce("peaks", F.array().cast("array<long>")), lambda y: (y >= begin) & (y < F.least(F.lit(height - 1).cast("long"), target + far)) & (F.abs(y - target) <= far))
        best = F.array_min(F.transform(near, lambda y: F.struct(F.abs(y - target).alias("off"), y.alias("y"))))["y"]
        found = F.coalesce(best, target)
        return F.concat(done, F.array(F.when(found <= last, last + least).otherwise(found)))

    placed = rows.select("page_id", "lines", F.aggregate("lines", F.array().cast("array<long>"), place).alias("centers"))
    return placed.select("page_id", F.inline(F.arrays_zip(F.col("lines.i").alias("i"), F.col("centers").alias("center"))))


def best_alignment(targets: np.ndarray, peaks: np.ndarray, skip: float) -> list[int | None]:
    """The order-keeping choice of a peak, or none, for each target with the least sum of distances; a line without a peak costs ``skip``.

    Dynamic programming over lines and peaks. Among equal sums the earlier line
    goes to the upper peak.
    """
    n, m = len(targets), len(peaks)
    cost = np.zeros((n + 1, m + 1))  # from line i on, with the peaks from j on
    for i in range(n - 1, -1, -1):
        cost[i, m] = cost[i + 1, m] + skip
        for j in range(m - 1, -1, -1):
            cost[i, j] = min(abs(targets[i] - peaks[j]) + cost[i + 1, j + 1], skip + cost[i + 1, j], cost[i, j + 1])
    out, j = [], 0
    for i in range(n):
        while j < m and cost[i, j] == cost[i, j + 1] and cost[i, j] != abs(targets[i] - peaks[j]) + cost[i + 1, j + 1]:
            j += 1
        if j < m and cost[i, j] == abs(targets[i] - peaks[j]) + cost[i + 1, j + 1]:
            out.append(int(peaks[j]))
            j += 1
        else:
            out.append(None)
    return out


def aligned_best(lines: DataFrame, peaks: DataFrame, height: int) -> DataFrame:
    """page_id, i, center: as :func:`aligned`, but by the alignment of a whole page with the least distance; null where a line gets no peak.

    Lines without a center are expected one spacing after the line before. A
    page's lines are one group; they are few.
    """

    def of_page(key: tuple, own: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        spacing = height / max(len(own) + 2, 1)
        targets: list[float] = []
        for center in own["center"]:
            targets.append(float(center) if pd.notna(center) else (targets[-1] if targets else 0.0) + int(spacing))
        found = best_alignment(np.asarray(targets), np.sort(tops["y"].to_numpy()), 2 * spacing)
        return pd.DataFrame({"page_id": key[0], "i": own["i"], "center": pd.array(found, "Int64")})

    return lines.select("page_id", "i", "center").groupBy("page_id").cogroup(peaks.groupBy("page_id")).applyInPandas(of_page, "page_id long, i long, center long")


def offsets() -> list[int]:
    """Where a calibration looks, from the expected place outwards, above before below."""
    return [0, *(s * k for k in range(STEP, FARTHEST + 1, STEP) for s in (-1, 1))]


def calibrated_spacing(pages: DataFrame, read: Callable[[int, list[int]], list[str]], keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """page_id, spacing, calls of every page; null where no crop was like the line.

    ``pages``: page_id, words (the line's first different words), expected (where
    it should be), box_h, page_h, anchor_y, between (lines from the anchor to
    it). ``read(page_id, tops)`` gives the text of each crop from those tops on.
    All open pages go through a round together, AT_ONCE crops each, nearest
    first; a page is closed by the first crop with half of the words, or by the
    best of all if that has 0.4. ``keep(frame, round)`` writes a round's table
    and reads it again.
    """
    c = F.col
    places = offsets()

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                tops = [y for y in r.tops]
                best, at, done = r.best, r.at, False
                if tops:
                    for y, text in zip(tops, read(int(r.page_id), [int(y) for y in tops])):
                        own = set(r.words)
                        overlap = len(own & set((text or "").lower().split()[:8])) / max(1, len(own))
                        if overlap > best:
                            best, at = overlap, float(y)
                        if overlap >= ENOUGH:
                            done = True
                            break
                out.append((r.page_id, best, at, r.calls + bool(tops), done))
            yield pd.DataFrame(out, columns=["page_id", "best", "at", "calls", "done"])

    facts = pages.select("page_id", "words", "expected", "box_h", "page_h")
    state = pages.select("page_id", F.lit(0.0).alias("best"), F.lit(None).cast("double").alias("at"), F.lit(0).cast("long").alias("calls"), F.lit(False).alias("done"))
    for number, begin in enumerate(range(0, len(places), AT_ONCE)):
        tops = F.array(*[F.lit(k).cast("long") for k in places[begin : begin + AT_ONCE]])
        tops = F.filter(F.transform(tops, lambda k: (c("expected") + k).cast("long")), lambda y: (y >= 0) & (y + c("box_h") <= c("page_h")))
        open_ = state.where("not done").join(facts, "page_id").select("page_id", "words", tops.alias("tops"), "best", "at", "calls")
        fresh = open_.mapInPandas(asked, "page_id long, best double, at double, calls long, done boolean")
        state = keep(state.where("done").unionByName(fresh), number)
        if state.where("not done").isEmpty():
            break
    spacing = F.when(c("best") >= LEAST, F.bround((c("at") - c("anchor_y")) / c("between")).cast("long"))
    return state.join(pages.select("page_id", "anchor_y", "between"), "page_id").select("page_id", spacing.alias("spacing"), "calls")
