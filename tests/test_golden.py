"""Known cases of the text expressions and layout operators."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marginalia.functions import domain as D, evidence as E, script as S, text as T
from marginalia.functions.stem import porter
from marginalia.operators import layout as L, names as N, raster as RA, relational as R, search as SE


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_spans_and_languages(spark):
    texts = ["Meeting நாளைக்கு at 10 AM", "10AM", "AM10", "ok.", "Hello —", "கூட்டம்", "कल बैठक है", "  ", None, "×÷ ½ ऀ१।", "Привет", "10।"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    spans = {}
    for r in S.text_spans(df).orderBy("id", "place").collect():
        spans.setdefault(r.id, []).append((r.span, r.script))
    assert spans[0] == [("Meeting", "Latin"), ("நாளைக்கு", "Tamil"), ("at", "Latin"), ("10", "Common"), ("AM", "Latin")]
    assert spans[1] == [("10", "Common"), ("AM", "Latin")] and spans[2] == [("AM10", "Latin")] and spans[3] == [("ok.", "Latin")]
    assert spans[9][0] == ("×÷", "Latin") and spans[10] == [("Привет", "Unknown")] and spans[11] == [("10", "Common"), ("।", "Devanagari")]
    got = {r.id: r for r in S.detect_language(df).collect()}
    assert got[0].language == "mixed" and (got[4].language, got[4].script) == ("en", "Mixed")
    assert got[5].language == "ta" and got[5].confidence > 0.9 and got[6].language == "hi" and got[6].confidence < 0.9
    assert all((got[k].language, got[k].confidence) == ("unknown", 0.0) for k in (7, 8))


def test_domains(spark):
    cases = {
        "Patient has diabetes and hypertension. Start metformin 500 mg.": "medical", "Revenue, expense, EBITDA and cash flow for Q4.": "finance", "The quick brown fox jumps over the lazy dog": "general",
        "party started early": "general", "": "general", "5mg": "general",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, expected string")
    for r in df.select("expected", D.detected(F.col("text")).alias("d")).collect():
        assert r.d.domain == r.expected and (r.d.confidence >= 0.62) == (r.expected != "general")
    # Alias and vocabulary both hold the word, so it counts twice.
    assert one(spark, D.detected(F.lit("patient"))).confidence == pytest.approx(0.7407)
    assert one(spark, D.has_term(D.normalized(F.lit("5mg")), "mg")) is False and one(spark, D.has_term(D.normalized(F.lit("2 mg/ml")), "mg")) is True


def test_context(spark):
    c = lambda text, forced=None: one(spark, D.context(F.lit(text), F.lit(forced).cast("string")))
    free = c("Patient prescribed metformin 500 mg for diabetes")
    assert free.domain == "medical" and "patient" in free.evidence and not free.forced and free.vocabulary[0] in ("mg", "patient")
    weak = c("question about the result")
    assert (weak.domain, weak.vocabulary, weak.evidence) == ("general", [], []) and [a.domain for a in weak.alternatives] == ["science", "education"]
    forced = c("take this", " Medical ")
    assert (forced.domain, forced.confidence, forced.forced, len(forced.vocabulary)) == ("medical", 1.0, True, 12)
    assert c("patient", "poetry").domain == "general" and c("", "auto").confidence == 0.0


def test_gate(spark):
    accept = one(spark, E.gate(F.lit("tomorow"), F.array(*map(F.lit, ("tomorrow", "tomorow", "tomorrov"))), F.lit(0.9), F.lit(1.0)))
    assert (accept.decision, accept.accepted, accept.risk) == ("ACCEPT", "tomorow", 0.2)
    abstain = one(spark, E.gate(F.lit("xyzqq"), F.array(*map(F.lit, ("meeting", "m33ting", "zzzzzz"))), F.lit(0.2), F.lit(0.2)))
    assert (abstain.decision, abstain.accepted) == ("ABSTAIN", "xyzqq")
    assert one(spark, E.similarity(F.lit("a  B"), F.lit("A b"))) == 1.0 and one(spark, E.similarity(F.lit(""), F.lit("x"))) == 0.0


def test_memory(spark):
    texts = spark.createDataFrame([(42, 1, "Karthik went"), (42, 2, "with (Karthik), home"), (42, 3, "Karthik/Karthik a"), (7, 4, "Karthak")], "document_id long, id long, text string")
    own, counts = E.remember(texts)
    rows = E.suggest(spark.createDataFrame([(42, "Karthlk"), (7, "zzz")], "document_id long, probe string"), own, counts).collect()
    assert [(r.document_id, r.term) for r in rows] == [(42, "Karthik")]
    assert {r.term: r["count"] for r in counts.collect()}["Karthik"] == 4


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=12), st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=12))
def test_fuzzy_join_loses_nothing(spark, left, right):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    got = E.fuzzy_join(spark.createDataFrame([(x,) for x in left], "probe string"), spark.createDataFrame([(x,) for x in right], "term string"))
    expected = {(a, b, distance(a, b)) for a in left for b in right if 1 - distance(a, b) / max(len(a), len(b)) >= 0.62 - 1e-9}
    assert {(r.probe, r.term, r.distance) for r in got.collect()} == expected


def plain_names(text):
    """Names by a loop over the words: phrases and endings are looked for at each word."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text)]
    low = [w.lower() for _, _, w in words]
    found = []
    for i in range(len(words)):
        for lead in (1, 0):
            for links in (["name", "is"], ["is", "called"], ["is", "named"], ["called"], ["named"], ["is"]):
                j = i + lead
                if j >= len(low) or low[j + 1 : j + 1 + len(links)] != links or j + 1 + len(links) >= len(words):
                    continue
                thing = re.sub("['’]s$", "", low[j]) if lead else low[j]
                fits = thing in N.THINGS and low[i] in N.DETERMINERS and links not in (["called"], ["named"]) if lead else thing in N.THINGS and links == ["name", "is"] or thing in N.NAMED_THINGS and links not in (["name", "is"], ["is"])
                if fits:
                    start = words[j + 1 + len(links)][0]
                    run = re.match(r"[^,;:!?\n\r]*", text[start:])[0]
                    if name := run.strip().rstrip(".").strip():
                        found.append((start, -(start + len(run.rstrip(" \t.)]}>"))), name))
                    break
        for n in range(N.ORG_WORDS, 0, -1):
            part = [w for _, _, w in words[i : i + n]]
            if len(part) == n and all(re.fullmatch(r"[A-Z][A-Za-z0-9&.-]*", w) for w in part) and i + n < len(words) and re.match(rf"(?:{'|'.join(N.SUFFIXES)})\b", words[i + n][2]):
                found.append((words[i][0], -words[i + n - 1][1], " ".join(part)))
                break
    out, upto = [], -1
    for start, back, name in sorted(found):
        if start >= upto:
            upto = -back
            out += [name] if name not in out else []
    return out


def test_fuzzy_join_of_many_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice(["an", "be", "cho", "d", "e", "ü"]) for _ in range(rng.randint(1, 6))) for _ in range(260)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    left, right = sorted(set(words[:90])), sorted(set(words[90:]))
    got = E.fuzzy_join(spark.createDataFrame([(x,) for x in left], "probe string"), spark.createDataFrame([(x,) for x in right], "term string"))
    expected = {(a, b, distance(a, b)) for a in left for b in right if 1 - distance(a, b) / max(len(a), len(b)) >= 0.62 - 1e-9}
    rows = [(r.probe, r.term, r.distance) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected) > 100


def test_names(spark):
    rng = random.Random(8)
    texts = ["My company's name is FISH, and we build software.", "I like to eat fish.", "We met Acme Widgets Inc. and Foo Labs today", "our app is called $1\\E x. the platform is Zed!", "", "Our team is Team Foo Labs; the product called Bar."]
    pool = ["my", "our", "the", "The", "company", "company's", "app", "website", "name", "is", "called", "named", "Acme", "Foo", "B&B", "Labs", "Ltd.", "Inc", "works", "on,", "end.", "x"]
    texts += [" ".join(rng.choices(pool, k=rng.randint(3, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, text string").withColumn("names", N.protected_names(F.col("text")))
    masked = N.mask(F.col("text"), N.by_length(F.col("names")))
    rows = df.select("i", "names", masked.alias("masked"), N.restore(F.lower(masked), N.by_length(F.col("names"))).alias("back")).collect()
    got = {r.i: r for r in rows}
    assert got[0].names == ["FISH"] and got[1].names == [] and got[2].names == ["Acme Widgets", "Foo"] and got[-1].names == []
    assert "ZXQPROTECTEDNAME0QXZ" in got[0].masked and got[0].back == "my company's name is FISH, and we build software."
    assert got[3].names == ["$1\\E x. the platform is Zed"] and got[3].back == texts[3]
    assert {i: got[i].names for i in range(len(texts))} == {i: plain_names(t) for i, t in enumerate(texts)}
    assert sum(map(len, (got[i].names for i in range(6, len(texts))))) > 100


def test_translation_fallback_and_requests(spark):
    df = spark.createDataFrame([(1, "alpha", "ta"), (2, "beta", "hi"), (3, "gamma", "bn"), (4, "कल बैठक है", "auto"), (5, "plain words", "unknown"), (6, " ", "ta"), (7, "12 34", "numeric"), (8, "same", "ta")], "id long, text string, source string")

    def first(text, source, target):
        if text in ("beta", "gamma"):
            raise ValueError("down")
        return "" if text == "alpha" else text if text == "same" else text.upper() + "!"

    second = lambda text, source, target: None if text == "gamma" else f"{text}-{source}"
    got = {r.id: (r.status, r.translated, r.error) for r in N.translate(df, first, fallback=second).collect()}
    assert got[1] == ("translated", "alpha-ta", None) and got[2] == ("translated", "beta-hi", None) and got[3] == ("error", None, "empty translation") and got[5][0] == "error"
    got = {r.id: (r.status, r.error) for r in N.translate_request(df, first, fallback=second).collect()}
    assert got[4] == ("translated", None) and got[5] == ("same", None) and got[6] == ("error", "no text") and got[8] == ("error", "translation equals the text") and got[7][0] == "error"


def test_translation_calls_once_for_each_text(spark):
    df = spark.createDataFrame([(1, "Our brand is called Zed, ok", "ta"), (2, "Our brand is called Zed, ok", "ta"), (3, " ", "ta"), (4, "hello", "en"), (5, "x", "mixed"), (6, None, "ta")], "id long, text string, source string")
    got = {r.id: (r.status, r.translated) for r in N.translate(df, lambda t, s, to: t.lower()).collect()}
    assert got == {1: ("translated", "our brand is called Zed, ok"), 2: ("translated", "our brand is called Zed, ok"), 3: ("blank", ""), 4: ("same", "hello"), 5: ("error", None), 6: ("blank", "")}


def test_uncertainty(spark):
    u = lambda c: one(spark, R.uncertainty(F.lit(c)))
    assert u(0.5) == pytest.approx(0.75) and u(1 / 3) == pytest.approx(0.7925, abs=1e-4) and u(0.0) == pytest.approx(0.5, abs=1e-6) and u(1.0) == pytest.approx(0, abs=1e-6)
    assert one(spark, R.uncertainty(F.lit(None).cast("double"), F.lit(True))) == pytest.approx(0.45)


def test_model_answers(spark):
    read = lambda raw: one(spark, T.normalized_items(T.model_items(F.lit(raw))))
    assert [x.text for x in read('```json\n[{"text": " a "}, {"text_content": "b"}, {"text": ""}]\n```')] == ["a", "b"]
    assert [x.text for x in read('Sure: [{"text": "a",}, ] done')] == ["a"] and [x.kind for x in read('{"detections": [{"type": "visual", "box": [1, 2, 3, 4]}]}')] == ["visual"]
    assert read("nothing here") is None


def test_reliability(spark):
    r = lambda t, ratio=0.05, pixels=3000, w=600, h=100: one(spark, T.reliability(F.lit(t), F.lit(0.9), F.lit(ratio), F.lit(pixels), F.lit(w), F.lit(h)))
    assert r("") == 0 and r("N/A") == 0 and r("a good line of text", 0.0, 0) <= 0.35
    assert r("a good [UNCERTAIN] line of text") < r("a good line of text") and r("ab") < r("a longer line of text")


def test_status_gate_and_paths(spark):
    assert [one(spark, ~F.lit(s).cast("string").eqNullSafe("processing")) for s in (None, "idle", "error", "processing", "done")] == [True, True, True, False, True]
    assert one(spark, T.normalized_path(F.lit(".\\data\\uploads\\1\\abc123.jpeg"))) == "data/uploads/1/abc123.jpeg"


def test_ink_kernels(spark):
    page = np.full((120, 200), 255, np.uint8)
    page[50:53, 10:190] = 0
    rows = spark.createDataFrame([(1, 200, 120, bytearray(page.tobytes()))], RA.RASTER)
    mask = np.frombuffer(RA.binarized(rows).first().gray, np.uint8).reshape(120, 200)
    assert mask[51, 100] == 255 and mask[10, 100] == 0
    turned = RA.rotated(rows, 90).first()
    assert (turned.width, turned.height) == (120, 200)
    assert (np.frombuffer(turned.gray, np.uint8).reshape(200, 120) == np.rot90(page, -1)).all()


def test_line_segments_of_a_tall_page(spark):
    rows = [(1, y, 9) for y in range(1000)] + [(2, y, 0) for y in range(300)] + [(3, y, 9 * (y // 20 % 2)) for y in range(200)]
    got = {}
    for r in L.line_segments(spark.createDataFrame(rows, "page_id long, pos int, ink int")).orderBy("page_id", "y0").collect():
        got.setdefault(r.page_id, []).append((r.y0, r.y1))
    assert len(got[1]) == 25 and got[1][-1] == (960, 1000) and got[2] == [(0, 300)] and got[3] == [(18, 42), (58, 82), (98, 122), (138, 162), (178, 200)]


def test_diversity(spark):
    rows = [(1, i, t, s) for i, (t, s) in enumerate([("hello world", 0.9), ("hello worlds", 0.8), ("other things", 0.7), ("hello world!", 0.6)])]
    got = [(r.id, r.place) for r in L.diverse(spark.createDataFrame(rows, "group long, id long, text string, score double"), 3).orderBy("place").collect()]
    assert got == [(0, 1), (2, 2), (1, 3)]


def test_plugin_failures_are_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad")), (3, bytearray(b"once"))], "page_id long, content binary")
    marks = str(tmp_path)

    def make():
        import pathlib
        import uuid

        pathlib.Path(marks, f"made-{uuid.uuid4().hex}").touch()
        tried = set()

        def read(content):
            if content == b"bad":
                raise ValueError("no")
            if content == b"once" and content not in tried:
                tried.add(content)
                raise ValueError("busy")
            return "EMPTY" if content == b"ok" else "second"

        return read

    with pytest.raises(LookupError):
        RA.recognized(pages, "nothing")
    RA.register("recognizer", make)
    assert RA.available("recognizer") and not RA.available("nothing")
    for _ in range(2):
        got = {r.page_id: (r.answer, r.error) for r in RA.recognized(pages.coalesce(1), pause=0).collect()}
    assert got == {1: ("", None), 2: (None, "no"), 3: ("second", None)}
    assert len(list(tmp_path.iterdir())) <= 4  # once for each worker, not for each task


def test_otsu_and_dark_rows(spark):
    rng = np.random.default_rng(2)
    gray = np.where(rng.random((40, 64)) < 0.2, rng.integers(10, 70, (40, 64)), rng.integers(170, 250, (40, 64))).astype(np.uint8)

    def between(level):
        low, high = gray[gray <= level].astype(float), gray[gray > level].astype(float)
        return len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else 0

    level = max(range(256), key=between)
    assert RA.otsu(gray) == level and RA.otsu(np.full((3, 3), 7, np.uint8)) == 0
    rows = RA.dark_rows(spark.createDataFrame([(1, 64, 40, bytearray(gray.tobytes()))], RA.RASTER)).orderBy("pos").collect()
    assert [r.ink for r in rows] == [float((gray[y, 8:56] <= level).sum()) for y in range(40)]


def test_ordered_match_and_nearest_peaks_by_loops(spark):
    rng = random.Random(3)
    texts = [(p, i, 40.0 * i + rng.uniform(-15, 15)) for p in range(12) for i in range(rng.randint(1, 12))]
    inks = [(p, j, 40.0 * j + rng.uniform(-25, 25), rng.choice([30.0, 36.0, 40.0, 200.0])) for p in range(12) for j in range(rng.randint(0, 12))]
    peaks = [(p, int(c)) for p, _, c, _ in inks]
    expected, near = {}, {}
    for p in range(12):
        own = sorted((gy, i) for q, i, gy in texts if q == p)
        ink = sorted((c, j, h) for q, j, c, h in inks if q == p)
        heights = sorted(h for _, _, h in ink)
        ink = [x for x in ink if x[2] <= 2.5 * heights[len(heights) // 2]]
        gaps = sorted(b[0] - a[0] for a, b in zip(ink, ink[1:]))
        reach, at = 2 * int(1.5 * (gaps[len(gaps) // 2] if gaps else 40)), 0
        for gy, i in own:
            hit = at < len(ink) and abs(gy - ink[at][0]) < reach
            expected[p, i] = ink[at][1] if hit else None
            at += hit
        places, last = sorted(x for q, x in peaks if q == p), None
        for gy, i in own:
            free = [x for x in places if last is None or x >= last + 20]
            near[p, i] = min(free, key=lambda x: (abs(x - gy), x)) if free else None
            last = last if near[p, i] is None else near[p, i]
    t = spark.createDataFrame(texts, "page_id long, i long, gy double")
    got = L.match_ordered(t, spark.createDataFrame(inks, "page_id long, j long, center double, height double")).collect()
    assert {(r.page_id, r.i): r.j for r in got} == expected
    got = RA.nearest_peaks(t.withColumnRenamed("gy", "at"), spark.createDataFrame(peaks, "page_id long, pos long"), 20).collect()
    assert {(r.page_id, r.i): r.pos for r in got} == near


@pytest.mark.parametrize("ahead", [1, 16])
def test_diverse_by_a_loop(spark, monkeypatch, ahead):
    monkeypatch.setattr(L, "LOOK_AHEAD", ahead)
    rng = random.Random(6)
    rows = [(g, 100 * g + i, "".join(rng.choice("ab ") for _ in range(rng.randint(1, 7))), rng.choice([0.1, 0.5, 0.9])) for g in range(5) for i in range(40)]
    grams = lambda t: {t.strip()[k : k + 2] for k in range(max(1, len(t.strip()) - 1))}
    expected = []
    for g in range(5):
        own, picked, skipped = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])), [], []
        for r in own:
            alike = [len(grams(r[2]) & grams(o[2])) / len(grams(r[2]) | grams(o[2])) for o in picked]
            (skipped if any(x > 0.7 for x in alike) or len(picked) == 6 else picked).append(r)
        expected += [(g, r[1], k) for k, r in enumerate((picked + skipped)[:6], 1)]
    got = L.diverse(spark.createDataFrame(rows, "group long, id long, text string, score double"), 6).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_stems_and_stemmed_search(spark):
    # Pairs of the algorithm's own description.
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
        "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile", "vietnamization": "vietnam",
        "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
        "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
        "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
        "controll": "control", "roll": "roll", "running": "run", "is": "is", "größen": "größen",
    }
    rows = spark.createDataFrame([(w,) for w in known], "word string").select("word", porter(F.col("word")).alias("stem")).collect()
    assert {r.word: r.stem for r in rows} == known
    docs = spark.createDataFrame([(7, 1, "doc-7")], "id long, user_id int, name string")
    results = spark.createDataFrame([(1, 7, 70, "He was running", 0.5, 1, 2, 3, 4), (2, 7, 70, "runs and runs", 0.6, 1, 2, 3, 4), (3, 7, 71, "a walk", 0.7, 1, 2, 3, 4)], "id long, document_id long, page_id long, text string, confidence double, x int, y int, w int, h int")
    assert SE.search(results, "run").count() == 0
    found = SE.hydrated(SE.search(results, "Run", stem=True), results, docs).orderBy("rank").collect()
    assert [(r.rank, r.id, r.document_name, r.text, r.page_id) for r in found] == [(1, 2, "doc-7", "runs and runs", 70), (2, 1, "doc-7", "He was running", 70)]
    assert found[0].score > found[1].score and SE.search(results, "", stem=True).count() == 0


def test_index_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "old words"), (2, 20, "other")], "user_id int, id long, text string")
    index = SE.postings(rows).join(rows.select("id", "user_id"), "id")
    path = str(tmp_path / "index")
    SE.write_index(index, path)
    fresh = spark.createDataFrame([(1, 11, "new")], "user_id int, id long, text string")
    new = SE.rebuilt(index, fresh, 1)
    SE.write_index(new.where("user_id = 1"), path)
    assert {(r.user_id, r.term) for r in spark.read.parquet(path).collect()} == {(1, "new"), (2, "other")}


def test_priors_of_one_script(spark):
    rows = S.alternatives(spark.createDataFrame([(1, "कल बैठक है"), (2, "plain"), (3, "কাল"), (4, "10")], "id long, text string")).collect()
    assert [r.language for r in sorted((r for r in rows if r.id == 1), key=lambda r: -r.share)] == ["mr", "ne", "sa", "mai", "kok", "doi", "brx"]
    assert {(r.language, r.share) for r in rows if r.id == 3} == {("as", 0.32), ("mni", 0.1)} and {r.id for r in rows} == {1, 3}


def test_summaries(spark):
    rows = spark.createDataFrame([(1, " One. Two."), (2, "  "), (3, "x" * 50_001), (4, "fail"), (5, None), (6, "x" * 50_000)], "id long, text string")

    def first(text, language):
        if text == "fail":
            raise ValueError("down")
        return f"{text.split('.')[0][:5]} ({language})"

    got = {r.id: (r.status, r.summary, r.error) for r in T.summaries(rows, S.source_language, first).collect()}
    assert got == {1: ("summarized", "One (en)", None), 2: ("error", None, "no text"), 3: ("error", None, "too long"), 4: ("error", None, "down"), 5: ("error", None, "no text"), 6: ("summarized", "xxxxx (en)", None)}


def test_prompt(spark):
    text = one(spark, D.prompt(D.context(F.lit("Patient prescribed metformin 500 mg for diabetes"))))
    assert text.startswith("DOMAIN HYPOTHESIS: medical (confidence 1.00)\n") and "patient" in text.split("CANDIDATE: ")[1].split("\n")[0] and "metformin" in text.split("VOCABULARY: ")[1].split("\n")[0]
    weak = one(spark, D.prompt(D.context(F.lit("question about the result"))))
    assert weak.startswith("DOMAIN HYPOTHESIS: general") and "VOCABULARY: none" in weak and "CANDIDATE: none" in weak


def test_quads_and_snapping(spark):
    lines = [(1, 1, True, 100, 100, 900, 110), (1, 2, True, 100, 400, 900, 402), (1, 3, False, 120, 80, 122, 500), (1, 4, False, 880, 80, 885, 500), (1, 5, False, 30, 80, 30, 500), (2, 1, True, 100, 100, 900, 100)]
    got = L.best_quad(spark.createDataFrame(lines, "page_id long, line_id long, horizontal boolean, x1 int, y1 int, x2 int, y2 int"), 1000, 750, (500.0, 250.0)).collect()
    assert [(r.page_id, r.top, r.bottom, r.left, r.right) for r in got] == [(1, 1, 2, 3, 4)]
    elements = spark.createDataFrame([(1, "underline", 50, 5, [[0, 0], [1, 1]]), (2, "arrow", 50, 5, [[0, 0], [1, 1]]), (3, "arrow", 50, 5, []), (4, "box", 50, 5, []), (5, "underline", 50, 50, [])], "id long, element_type string, w int, h int, points array<array<long>>")
    found = spark.createDataFrame([(i, 0, 0, 40, 2) for i in range(1, 5)] + [(1, 0, 0, 30, 45), (3, 0, 0, 20, 0), (5, 0, 0, 1, 45)], "id long, x1 long, y1 long, x2 long, y2 long")
    flat = [[0, 0], [40, 2]]
    assert {r.id: r.points for r in L.snapped(elements, found).collect()} == {1: flat, 2: [[0, 0], [1, 1]], 3: flat, 4: [], 5: []}


def test_ink_mask_by_loops():
    rng = np.random.default_rng(4)
    gray = rng.integers(120, 256, (18, 23)).astype(np.uint8)
    gray[5:9, 4:15] = rng.integers(0, 60, (4, 11))
    radius, offset = 3, 25.0
    at = range(-radius, radius + 1)
    weight = [math.exp(-0.5 * (k / (0.3 * (radius - 1) + 0.8)) ** 2) for k in at]
    weight = [w / sum(weight) for w in weight]
    clip = lambda v, n: min(max(v, 0), n - 1)
    mean = lambda y, x: sum(wy * wx * float(gray[clip(y + dy, 18), clip(x + dx, 23)]) for dy, wy in zip(at, weight) for dx, wx in zip(at, weight))
    dark = np.array([[gray[y, x] < mean(y, x) - offset for x in range(23)] for y in range(18)])
    opened = np.zeros_like(dark)
    for y in range(17):
        for x in range(22):
            if dark[y : y + 2, x : x + 2].all():
                opened[y : y + 2, x : x + 2] = True
    assert (RA.ink_mask(gray, radius, offset) == opened).all() and 10 < opened.sum() < dark.sum() + 1


def test_ink_lines_by_a_loop(spark):
    rng = random.Random(9)
    rows, expected = [], []
    for page in range(8):
        ink = []
        for _ in range(12):
            ink += [0.0] * rng.randint(1, 12) + [rng.uniform(30, 90) for _ in range(rng.choice([4, 20, 24, 60, 90]))]
        rows += [(page, y, v) for y, v in enumerate(ink)]
        padded = [0.0, *ink, 0.0]
        smooth = [sum(padded[y : y + 3]) / 3 for y in range(len(ink))]
        some = sorted(v for v in smooth if v > 0)
        place = (len(some) - 1) * 0.25
        level = max(some[int(place)] + (some[min(int(place) + 1, len(some) - 1)] - some[int(place)]) * (place - int(place)), 20.0)
        runs, y = [], 0
        while y < len(ink):
            stop = y
            while stop < len(ink) and smooth[stop] >= level:
                stop += 1
            if stop - y > 15:
                runs.append((y, stop))
            y = max(stop, y + 1)
        median = sorted(b - a for a, b in runs)[len(runs) // 2]
        for a, b in runs:
            parts = max(1, round((b - a) / median)) if b - a > 2 * median else 1
            cuts = [a]
            for k in range(1, parts):
                middle, reach = a + (b - a) * k // parts, max(1, median // 3)
                near = range(max(cuts[-1] + 1, middle - reach), min(b - 1, middle + reach) + 1)
                cuts.append(min(near, key=lambda v: (smooth[v], v)) if near else middle)
            expected += [(page, u, v) for u, v in zip(cuts, [*cuts[1:], b])]
    got = RA.ink_lines(spark.createDataFrame(rows, "page_id long, pos int, ink double")).collect()
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 30


def test_warp_and_deskew(spark):
    rng = np.random.default_rng(7)
    page = rng.integers(0, 256, (40, 60)).astype(np.uint8)
    assert (RA.warped(page, [(0, 0), (59, 0), (59, 39), (0, 39)], 60, 40) == page).all()
    assert (RA.warped(page, [(10, 5), (29, 5), (29, 24), (10, 24)], 20, 20) == page[5:25, 10:30]).all()
    assert (RA.warped(page, [(29, 5), (29, 24), (10, 24), (10, 5)], 20, 20) == np.rot90(page[5:25, 10:30])).all()
    assert (RA.straightened(page, 0.0) == page).all()
    lines = np.full((101, 201), 255, np.uint8)
    slope = np.tan(np.radians(4))
    for x in range(201):
        for base in (30, 50, 70):
            y = int(round(base + (x - 100) * slope))
            lines[max(0, y - 1) : y + 2, x] = 0
    rows = spark.createDataFrame([(1, 201, 101, bytearray(lines.tobytes())), (2, 201, 101, bytearray(lines.tobytes()))], RA.RASTER)
    got = {r.page_id: np.frombuffer(r.gray, np.uint8).reshape(r.height, r.width) for r in RA.deskewed(rows, spark.createDataFrame([(1, 4.0)], "page_id long, angle double")).collect()}
    dark = lambda a: (a[:, 30:-30] < 128).mean(1)
    assert dark(got[1]).max() > 0.95 and dark(got[2]).max() < 0.6 and got[1].shape > lines.shape and (got[2] == lines).all()


def test_exif_orientation():
    body = lambda order, o: b"Exif\0\0" + (b"II*\0" if order == "little" else b"MM\0*") + (8).to_bytes(4, order) + (2).to_bytes(2, order) + b"".join(t.to_bytes(2, order) + (3).to_bytes(2, order) + (1).to_bytes(4, order) + v.to_bytes(2, order) + b"\0\0" for t, v in ((0x0100, 9), (0x0112, o)))
    for order in ("little", "big"):
        for o in range(1, 9):
            own = body(order, o)
            assert RA.exif_orientation(b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + (len(own) + 2).to_bytes(2, "big") + own + b"\xff\xda") == o
    assert RA.exif_orientation(b"") == RA.exif_orientation(b"\x89PNG") == RA.exif_orientation(b"\xff\xd8\xff\xda\0\2") == RA.exif_orientation(b"\xff\xd8\xff\xe1\0\x08Exif\0\0") == 1
