"""Kernels on gray rasters, as arrays, and hooks for codecs and recognizers.

A raster row is (page_id, width, height, gray), gray as bytes row by row. The
kernels run in Arrow batches; reading image files needs a decoder, which is
given as a function, like the recognizer.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

RASTER = "page_id long, width int, height int, gray binary"


def _blurred(gray: np.ndarray, radius: int) -> np.ndarray:
    """Gaussian local mean, separable, edges repeated."""
    at = np.arange(-radius, radius + 1)
    weight = np.exp(-0.5 * (at / max(0.3 * (radius - 1) + 0.8, 1e-6)) ** 2)
    weight /= weight.sum()
    for axis in (0, 1):
        wide = np.pad(gray, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        gray = sum(w * np.take(wide, np.arange(gray.shape[axis]) + k, axis) for k, w in enumerate(weight))
    return gray


def ink_mask(gray: np.ndarray, radius: int = 15, offset: float = 25.0, opening: int = 2) -> np.ndarray:
    """Where a raster is darker than its local mean by ``offset``, opened by a square of ``opening``."""
    mask = gray < _blurred(gray.astype(np.float64), radius) - offset
    if opening > 1 and min(mask.shape) >= opening:
        windows = np.lib.stride_tricks.sliding_window_view(mask, (opening, opening))
        eroded = windows.all((2, 3))
        mask = np.zeros_like(mask)
        for dy in range(opening):
            for dx in range(opening):
                mask[dy : dy + eroded.shape[0], dx : dx + eroded.shape[1]] |= eroded
    return mask


def _mapped(rasters: DataFrame, of: Callable[..., np.ndarray], also: list[str] | None = None) -> DataFrame:
    """Rasters that ``of`` makes of each raster and the columns ``also``."""
    names = also or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, width, height, gray, *more in zip(*(batch[c] for c in ("page_id", "width", "height", "gray", *names))):
                out = of(np.frombuffer(gray, np.uint8).reshape(height, width), *more)
                rows.append((page, out.shape[1], out.shape[0], np.ascontiguousarray(out, np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["page_id", "width", "height", "gray"])

    return rasters.select("page_id", "width", "height", "gray", *names).mapInPandas(run, RASTER)


def binarized(rasters: DataFrame) -> DataFrame:
    """Ink as 255, background as 0."""
    return _mapped(rasters, lambda gray: ink_mask(gray) * 255)


def rotated(rasters: DataFrame, degrees: int) -> DataFrame:
    """Turned clockwise by a multiple of 90 degrees."""
    if degrees % 90:
        raise ValueError("degrees must be a multiple of 90")
    return _mapped(rasters, lambda gray: np.rot90(gray, -(degrees // 90) % 4))


def sampled(gray: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at real places, between the four pixels around; beyond the edges their nearest pixels."""
    height, width = gray.shape
    x, y = np.clip(x, 0, width - 1), np.clip(y, 0, height - 1)
    left, top = np.minimum(x.astype(int), max(width - 2, 0)), np.minimum(y.astype(int), max(height - 2, 0))
    right, low = np.minimum(left + 1, width - 1), np.minimum(top + 1, height - 1)
    u, v, own = x - left, y - top, gray.astype(float)
    above, below = own[top, left] * (1 - u) + own[top, right] * u, own[low, left] * (1 - u) + own[low, right] * u
    return np.rint(above * (1 - v) + below * v).astype(np.uint8)


def straightened(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Turned back about its center by a skew of ``degrees``; the canvas grows so that nothing is lost, edges are repeated."""
    height, width = gray.shape
    turn = np.radians(degrees)
    cos, sin = np.cos(turn), np.sin(turn)
    wide, tall = int(height * abs(sin) + width * abs(cos)), int(height * abs(cos) + width * abs(sin))
    dx, dy = np.meshgrid(np.arange(wide) - wide / 2, np.arange(tall) - tall / 2)
    return sampled(gray, width // 2 + cos * dx - sin * dy + (width / 2 - width // 2), height // 2 + sin * dx + cos * dy + (height / 2 - height // 2))


def warped(gray: np.ndarray, corners: list[tuple[float, float]], width: int, height: int) -> np.ndarray:
    """The quadrangle of ``corners`` (top left, top right, bottom right, bottom left) as an upright raster."""
    rows, values = [], []
    for (x, y), (u, v) in zip([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], corners):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    a, b, c, d, e, f, g, h = np.linalg.solve(np.asarray(rows, float), np.asarray(values, float))
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    depth = g * x + h * y + 1
    return sampled(gray, (a * x + b * y + c) / depth, (d * x + e * y + f) / depth)


def deskewed(rasters: DataFrame, angles: DataFrame) -> DataFrame:
    """Rasters turned back by their page's angle (page_id, angle); without one, or with 0, they stay."""
    rows = rasters.join(angles.select("page_id", "angle"), "page_id", "left").fillna(0.0, "angle")
    return _mapped(rows, lambda gray, angle: straightened(gray, angle) if angle else gray, ["angle"])


#: What undoes each EXIF orientation.
_UPRIGHT: dict[int, Callable[[np.ndarray], np.ndarray]] = {
    2: lambda a: a[:, ::-1], 3: lambda a: a[::-1, ::-1], 4: lambda a: a[::-1], 5: lambda a: a.T, 6: lambda a: np.rot90(a, -1), 7: lambda a: a[::-1, ::-1].T, 8: lambda a: np.rot90(a),
}


def exif_orientation(content: bytes) -> int:
    """The orientation (1 to 8) that a JPEG's EXIF header names; 1 without one."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        body = content[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda k, n: int.from_bytes(tiff[k : k + n], order)
            first = number(4, 4)
            for entry in range(first + 2, first + 2 + 12 * number(first, 2), 12):
                if number(entry, 2) == 0x0112:
                    found = number(entry + 8, 2)
                    return found if 1 <= found <= 8 else 1
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def decoded(images: DataFrame, kind: str = "decoder") -> DataFrame:
    """(page_id, content) -> upright rasters: the registered decoder's gray array, turned as the EXIF header says."""
    get = plugin(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = get()
        for batch in batches:
            rows = []
            for page, content in zip(batch["page_id"], batch["content"]):
                gray = _UPRIGHT.get(exif_orientation(content), lambda a: a)(decode(content))
                rows.append((page, gray.shape[1], gray.shape[0], np.ascontiguousarray(gray, np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["page_id", "width", "height", "gray"])

    return images.select("page_id", "content").mapInPandas(run, RASTER)


def read_lines(rasters: DataFrame, lines: DataFrame, kind: str = "line recognizer", offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """page_id, i, x, y, w, h, text: each line (page_id, i, x, y, w, h; a page's are few) cut out and recognised; ``offset`` is where the raster lies on its page."""
    get = plugin(kind)
    own = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y", "w", "h"))).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognize = get()
        for batch in batches:
            rows = []
            for page, width, height, gray, boxes in zip(*(batch[c] for c in ("page_id", "width", "height", "gray", "lines"))):
                whole = np.frombuffer(gray, np.uint8).reshape(height, width)
                for b in boxes:
                    x, y = max(0, b["x"]), max(0, b["y"])
                    rows.append((page, b["i"], x + offset[0], y + offset[1], b["w"], b["h"], recognize(whole[y : b["y"] + b["h"], x : b["x"] + b["w"]])))
            yield pd.DataFrame(rows, columns=["page_id", "i", "x", "y", "w", "h", "text"])

    return rasters.join(own, "page_id").select("page_id", "width", "height", "gray", "lines").mapInPandas(run, "page_id long, i long, x long, y long, w long, h long, text string")


def otsu(gray: np.ndarray) -> int:
    """The level that parts a raster's values into two classes with the largest variance between them; the lower class holds it."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    below = counts.cumsum()
    mass = (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def _profiled(rasters: DataFrame, of: Callable[[np.ndarray], list[tuple[str, np.ndarray]]]) -> DataFrame:
    """page_id, axis, pos, ink of the profiles that ``of`` makes of each raster; a frame for each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [
                (page, axis, own)
                for page, width, height, gray in zip(batch["page_id"], batch["width"], batch["height"], batch["gray"])
                for axis, own in of(np.frombuffer(gray, np.uint8).reshape(height, width))
            ]
            sizes = [len(own) for _, _, own in made]
            yield pd.DataFrame({
                "page_id": np.repeat([page for page, _, _ in made], sizes), "axis": np.repeat([axis for _, axis, _ in made], sizes),
                "pos": np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int), "ink": np.concatenate([own for _, _, own in made] or [[]]),
            })

    return rasters.select("page_id", "width", "height", "gray").mapInPandas(run, "page_id long, axis string, pos int, ink double")


def profiles(rasters: DataFrame) -> DataFrame:
    """page_id, axis, pos, ink: row and column sums of a raster / 255."""
    return _profiled(rasters, lambda gray: [("row", (gray / 255.0).sum(1)), ("column", (gray / 255.0).sum(0))])


def dark_rows(rasters: DataFrame) -> DataFrame:
    """page_id, pos, ink: dark pixels of each row, by Otsu's level, in the middle 75 % of the width; rules at the margins stay out."""

    def of(gray: np.ndarray) -> list[tuple[str, np.ndarray]]:
        edge = gray.shape[1] // 8
        return [("row", (gray[:, edge : gray.shape[1] - edge] <= otsu(gray)).sum(1).astype(float))]

    return _profiled(rasters, of).drop("axis")


def split_blobs(heights: np.ndarray, starts: np.ndarray, profile: np.ndarray) -> list[tuple[int, int]]:
    """Ink lines (start, stop): lines more than twice as high as the upper median are cut at the valleys of the profile."""
    if not len(heights):
        return []
    median = int(np.sort(heights)[len(heights) // 2])
    out = []
    for start, height in zip(starts.tolist(), heights.tolist()):
        parts = max(1, round(height / median)) if height > 2 * median else 1
        cuts = [start]
        for k in range(1, parts):
            middle, reach = start + height * k // parts, max(1, median // 3)
            low = max(cuts[-1] + 1, middle - reach)
            high = min(start + height - 1, middle + reach)
            cuts.append(low + int(np.argmin(profile[low : high + 1])) if high >= low else middle)
        out += list(zip(cuts, [*cuts[1:], start + height]))
    return out


def ink_lines(profile_rows: DataFrame) -> DataFrame:
    """page_id, start, stop: ink lines of (page_id, pos, ink) profiles above the 25th percentile of their ink, 20 at least.

    Rows are smoothed by three; lines of 15 rows or less are specks. Cutting
    blobs looks at neighbours one after the other, so a page is one group.
    """

    def of_page(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ink = rows.sort_values("pos")["ink"].to_numpy(float)
        smooth = np.convolve(ink, np.ones(3) / 3, "same")
        some = smooth[smooth > 0]
        level = max(float(np.percentile(some, 25)) if len(some) else 0.0, 20.0)
        edge = np.diff(np.concatenate([[0], (smooth >= level).astype(int), [0]]))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        kept = stops - starts > 15
        return pd.DataFrame([(key[0], a, b) for a, b in split_blobs((stops - starts)[kept], starts[kept], smooth)], columns=["page_id", "start", "stop"])

    return profile_rows.groupBy("page_id").applyInPandas(of_page, "page_id long, start int, stop int")


def nearest_peaks(expected: DataFrame, peaks: DataFrame, least_gap: int) -> DataFrame:
    """page_id, i, pos: each expected line's (page_id, i, at) nearest peak (page_id, pos), in order, ``least_gap`` apart; null where none is left.

    A page's lines and peaks are folded as arrays inside its row; of two peaks
    as near, the upper one is taken.
    """
    lines = expected.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), F.col("i").cast("long").alias("i")))).alias("lines"))
    places = peaks.groupBy("page_id").agg(F.sort_array(F.collect_list(F.col("pos").cast("long"))).alias("places"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<i: long, pos: long>>").alias("out"))

    def step(state: Column, line: Column) -> Column:
        free = F.filter("places", lambda p: state["last"].isNull() | (p >= state["last"] + least_gap))
        pos = F.array_min(F.transform(free, lambda p: F.struct(F.abs(p - line["at"]).alias("off"), p.alias("p"))))["p"]
        return F.struct(F.coalesce(pos, state["last"]).alias("last"), F.concat(state["out"], F.array(F.struct(line["i"].alias("i"), pos.alias("pos")))).alias("out"))

    return lines.join(places, "page_id", "left").select("page_id", F.inline(F.aggregate("lines", start, step)["out"]))


#: What builds the function of a kind (decoder, recognizer, translator, summarizer), as registered on the driver.
_PLUGINS: dict[str, tuple[str, Callable[[], Callable]]] = {}
#: Functions of a Python worker, by registration.
_MADE: dict[str, Callable] = {}


def register(kind: str, make: Callable[[], Callable]) -> None:
    """``make`` builds the function; it is called once in each Python worker, so models are loaded there. A new one takes the place of the old."""
    _PLUGINS[kind] = (uuid.uuid4().hex, make)


def available(kind: str) -> bool:
    return kind in _PLUGINS


def plugin(kind: str) -> Callable[[], Callable]:
    """What gives the registered function in a worker; built there at its first use."""
    if kind not in _PLUGINS:
        raise LookupError(f"no {kind} is registered")
    token, make = _PLUGINS[kind]

    def get() -> Callable:
        if token not in _MADE:
            _MADE[token] = make()
        return _MADE[token]

    return get


def recognized(pages: DataFrame, kind: str = "recognizer", attempts: int = 2, pause: float = 1.0) -> DataFrame:
    """(page_id, content) -> page_id, answer, error: the registered recognizer's answer.

    A failing call is tried again after ``pause`` seconds; what fails in the end
    is a row, not an exception. EMPTY is an empty answer.
    """
    get = plugin(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognizer = get()
        for batch in batches:
            rows = []
            for page, content in zip(batch["page_id"], batch["content"]):
                answer, error = None, None
                for k in range(attempts):
                    if k:
                        time.sleep(pause)
                    try:
                        answer, error = recognizer(content), None
                        break
                    except Exception as e:  # a plug-in may raise anything
                        error = str(e)
                rows.append((page, "" if answer == "EMPTY" else answer, error))
            yield pd.DataFrame(rows, columns=["page_id", "answer", "error"])

    return pages.select("page_id", "content").mapInPandas(run, "page_id long, answer string, error string")
