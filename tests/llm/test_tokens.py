import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm.packing import Plan, class_edges, nnls, pack_documents, patterns, plan
from marginalia.llm.tokencount import RULES, count_tokens, line_sections, with_sections
from marginalia.llm.tokens import WordEncoder, tokenizer_path

from .cases import documents, empty, frame

PATH = tokenizer_path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def test_word_cache_equals_whole_texts():
    texts = [t or "" for _, t, _ in documents()] + ["Don't STOP: it's 123ab ß ﬁ é́ x", "ΣΟΦΟΣ Σ, é. É!! ́abc", "日本語 x y\x1cq  z", "a" * 3000]
    encoder = WordEncoder(PATH, offsets=True, max_words=300)
    for text in texts:
        flat, _ = encoder.tokens(encoder.look_up(text.encode().split()))
        assert flat[0].tolist() == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", RULES)
def test_sections(spark, rule):
    for sections in (None, line_sections):
        got = {}
        for r in count_tokens(frame(spark), PATH, sections, rule).collect():
            got.setdefault(r.doc_id, []).append(r)
        for doc_id, text, _ in documents():
            spans = WHOLE.encode(text or "", add_special_tokens=False).offsets
            own = got[doc_id]
            repeats = sum(d == doc_id for d, _, _ in documents())
            assert sum(r.n_tokens for r in own) == repeats * len(spans)
            for r in own:
                if r.section is None:
                    continue
                at = [a if rule == "first" else b - 1 if rule == "last" else (a + b - 1) // 2 for a, b in spans]
                inside = [(a, b) for x, (a, b) in zip(at, spans) if r.start <= x < r.stop]
                assert (r.n_tokens, r.n_crossing) == (len(inside), sum(a < r.start or b > r.stop for a, b in inside))
    assert count_tokens(empty(spark), PATH).count() == 0


def test_section_frame(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id long, text string")
    sections = spark.createDataFrame([(1, "b", 6, 16), (1, "a", 0, 6)], "doc_id long, section string, start int, stop int")
    rows = count_tokens(with_sections(docs, sections), PATH, F.col("sections")).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.section) for r in rows] == [(1, "a"), (1, "b"), (2, None)]


def test_pieces_and_places(spark):
    for size in (4096, 64, 7):
        rows = pack_documents(frame(spark).withColumn("offset", F.lit(1)), PATH, size=size).collect()
        expected = []
        for doc_id, text, _ in documents():
            ids = WHOLE.encode(text or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), size):
                part = np.asarray(ids[k : k + size], "<u4")
                expected.append((doc_id, k // size, k, len(part), zlib.crc32(part.tobytes())))
        assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
        packed = {}
        for r in rows:
            packed.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in packed.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= size
    assert pack_documents(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("size", [50, 64, 1000, 4000, 4095, 4096, 4097])
def test_plan_is_tight(size):
    for mu, sigma in ((5.5, 1), (6.3, 1), (6.5, 0.8), (7, 0.6), (7.3, 0.4), (7.6, 0.3), (7, 1)):
        rng = np.random.default_rng(int(10 * mu))
        lengths = np.ceil(rng.lognormal(mu, sigma, 20_000) * size / 4096).astype(int)
        histogram = np.bincount(lengths % size, minlength=size + 1)
        histogram[0], histogram[size] = 0, (lengths // size).sum()
        own = plan(histogram)
        placed = np.asarray(own.segments)
        assert own.left.sum() == 0 and (np.bincount(placed[:, 0], placed[:, 2], size + 1) == histogram).all()
        none = np.zeros((len(class_edges(size)) - 1, 0))
        fit = Plan(histogram, none, np.zeros(0)).sequences
        least = -(-int(lengths.sum()) // size)
        assert least <= own.sequences <= fit
        if (size, mu) in ((4096, 5.5), (4096, 6.3), (4096, 6.5)):
            assert own.sequences <= least + 1


def test_patterns_are_exact():
    """Sequences of patterns are full: their documents' lengths sum to the size."""
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.minimum(1000, rng.lognormal(5.6, 0.6, 20_000).astype(int) + 1), minlength=1001)
    shapes = patterns(64)
    fitted = np.floor(nnls(shapes, np.diff(np.cumsum(histogram)[class_edges(1000)]).astype(float)))
    own = Plan(histogram, shapes, fitted)
    filled = np.zeros(own.sequences + 1, np.int64)
    for length, _, count, sequence, _ in own.segments:
        filled[sequence : sequence + count] += length
    assert fitted.sum() > 3000 and (filled[:3000] == 1000).all()


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 50)), np.maximum(rng.normal(size=50), 0)
    got = nnls(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6
    assert (patterns().T @ np.arange(1, 65) == 64).all()
