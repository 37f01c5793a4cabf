"""Lines on ink against plain loops: blurred profiles, greedy and best alignments, calibration by rounds."""

import itertools
import random

import numpy as np

from marginalia.operators import linealign as A, strokes as K


def plain_greedy(centers, peaks, height):
    spacing = height / max(len(centers) + 2, 1)
    least, far, out = max(int(spacing * 0.3), 10), int(spacing * 2), []
    for gc in centers:
        if gc is None:
            gc = (out[-1] if out else 0) + int(spacing)
        if out:
            gc = max(gc, out[-1] + least)
        best, dist = gc, far + 1
        for j in range(max(1, out[-1] + least if out else 0), min(height - 1, gc + far)):
            if j in peaks and abs(j - gc) < dist:
                best, dist = j, abs(j - gc)
        if out and best <= out[-1]:
            best = out[-1] + least
        out.append(best)
    return out


def test_alignments(spark):
    rng = random.Random(4)
    lines, peaks, expected, best = [], [], {}, {}
    for p in range(60):
        height, n = 400, rng.randrange(1, 7)
        centers = [rng.choice([None, rng.randrange(400), 60 * k + rng.randrange(-9, 10)]) for k in range(n)]
        tops = sorted(rng.sample(range(1, 399), rng.randrange(0, 8)))
        lines += [(p, i, c) for i, c in enumerate(centers)]
        peaks += [(p, y) for y in tops]
        expected[p] = plain_greedy(centers, set(tops), height)
        targets = []
        for c in centers:
            targets.append(float(c) if c is not None else (targets[-1] if targets else 0.0) + int(height / (n + 2)))
        skip = 2 * height / (n + 2)
        best[p] = min(sum(abs(t - y) if y is not None else skip for t, y in zip(targets, pick)) for pick in choices(n, tops))
        own = A.best_alignment(np.asarray(targets), np.asarray(tops), skip)
        assert abs(sum(abs(t - y) if y is not None else skip for t, y in zip(targets, own)) - best[p]) < 1e-6
        assert [y for y in own if y is not None] == sorted({y for y in own if y is not None})
    line_frame, peak_frame = spark.createDataFrame(lines, "page_id long, i int, center long"), spark.createDataFrame(peaks, "page_id long, y long")
    got = {}
    for r in A.aligned(line_frame, peak_frame, 400).collect():
        got.setdefault(r.page_id, {})[r.i] = r.center
    assert {p: [own[i] for i in range(len(own))] for p, own in got.items()} == expected
    whole = A.aligned_best(line_frame, peak_frame, 400).collect()
    assert len(whole) == len(lines)


def choices(n, tops):
    """All ways to give n lines peaks, or none, in order."""
    for k in range(min(n, len(tops)) + 1):
        for who in itertools.combinations(range(n), k):
            for which in itertools.combinations(tops, k):
                out = [None] * n
                for i, y in zip(who, which):
                    out[i] = y
                yield out


def test_profile(spark):
    rng = np.random.default_rng(2)
    width, height = 440, 90
    ink = np.zeros((height, width), bool)
    for y in (3, 20, 21, 50, 86):
        ink[y] = rng.random(width) < 0.6
    ink[60] = True  # a ruled line
    ink[59, :40] = ink[40, :109] = True
    pixels = [(1, int(x), int(y)) for y, x in zip(*np.nonzero(ink))]
    got = A.handwriting(spark.createDataFrame(pixels, "page_id long, x long, y long"), width)
    left = ink.copy()
    left[59:62] = False  # 440 pixels: a run of 110 is ruled, one of 109 is not
    assert {(r.x, r.y) for r in got.collect()} == {(int(x), int(y)) for y, x in zip(*np.nonzero(left))}
    w = A.weights()
    rows = left.sum(1)
    mirror = lambda y: -y if y < 0 else 2 * (height - 1) - y if y >= height else y
    smooth = [sum(int(rows[mirror(y + k)]) * w[abs(k)] for k in range(-7, 8)) for y in range(height)]
    most = max(smooth)
    expected = [y for y in range(1, height - 1) if smooth[y] * 100 > most * 8 and smooth[y] > 65536 and smooth[y] > smooth[y - 1] and smooth[y] >= smooth[y + 1]]
    assert sorted(r.y for r in A.profile_peaks(got, height).collect()) == expected and len(expected) > 3


def test_calibration_by_rounds(spark, tmp_path):
    """As a plain loop over crops decides, in seven requests a page at most."""
    truth = {p: 300 + (p * 37) % 260 - 130 for p in range(30)}

    def crop_text(page, top):
        off = abs(top - truth[page])
        return "The quick brown fox" if off <= 8 else "the fox" if off <= 20 else "the lazy" if off <= 40 and page % 2 else ""

    def read(page, tops):
        return [crop_text(page, t) for t in tops]

    words = ["the", "quick", "brown", "fox"]
    rows = [(p, words, 300.0 + p % 3 / 2, 40.0, 700 if p % 5 else 330, 100.0, 5) for p in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, words array<string>, expected double, box_h double, page_h int, anchor_y double, between int")

    def keep(df, n):
        df.write.parquet(str(tmp_path / f"round{n}"))
        return spark.read.parquet(str(tmp_path / f"round{n}"))

    expected = {}
    for p, own, est, h, page_h, anchor, between in rows:
        best, at = 0.0, None
        for k in A.offsets():
            y = int(est + k)
            if y < 0 or y + h > page_h:
                continue
            overlap = len(set(own) & set(crop_text(p, y).lower().split()[:8])) / 4
            if overlap > best:
                best, at = overlap, y
            if overlap >= 0.5:
                break
        expected[p] = int(round((at - anchor) / between)) if at is not None and best >= 0.4 else None
    got = A.calibrated_spacing(frame, read, keep).collect()
    assert {r.page_id: r.spacing for r in got} == expected and max(r.calls for r in got) <= 7
    assert any(v is None for v in expected.values()) and sum(v is not None for v in expected.values()) > 10 and len(list(tmp_path.iterdir())) <= 7


def test_rows_of_handwriting_from_runs(spark):
    """Counted from runs as from pixels, where ruled lines overlap ink of the rows beside them."""
    rng = random.Random(6)
    ink = set()
    for p in range(5):
        ink |= {(p, rng.randrange(300), rng.randrange(40)) for _ in range(900)}
        for _ in range(4):
            x, y = rng.randrange(120), rng.randrange(40)
            ink |= {(p, x + a, y) for a in range(rng.choice([99, 100, 101, 160]))}
    pixels = spark.createDataFrame(sorted(ink), "page_id long, x long, y long")
    expected = {}
    for r in A.handwriting(pixels, 300).collect():
        expected[r.page_id, r.y] = expected.get((r.page_id, r.y), 0) + 1
    got = A.handwriting_rows(K.runs(pixels), 300)
    assert {(r.page_id, r.y): r.n for r in got.collect()} == expected
    peaks = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert peaks(A.row_peaks(got, 40)) == peaks(A.profile_peaks(A.handwriting(pixels, 300), 40)) != []
