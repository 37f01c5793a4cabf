import math
import random
import re
from zlib import crc32

from marginalia.llm.licenses import BITS, CLASSES, CONTAINED, _made, scan_licenses, trained, words_of

from .cases import empty, frame


def test_held_out_paragraphs():
    model = trained()
    texts, labels = _made(random.Random(4321), 30)
    parts = [words_of(t) for t in texts]
    assert (model.probabilities(parts).argmax(1) == labels).mean() > 0.97
    found = {i: family for i, family, _, _ in model.decide(parts)}
    assert sum(i in found for i, y in enumerate(labels) if y == 0) <= 0.01 * labels.count(0)


def test_families_and_unknown(spark):
    docs = [
        (1, "prose before it\nLicensed under the Apache License, Version 2.0.\nprose after it"), (2, "Released under the MIT License."), (3, "All rights reserved."), (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "Licensed under CC BY-NC 4.0."), (6, "Licensed under the Zorbal Community License, version 2."), (7, "He lost his driving license on the way to the harbour."), (8, "The general public was not allowed into the hall"), (9, None), (10, ""),
        (11, " ".join(["wort"] * 20_000) + " Released under the MIT License. " + " ".join(["wort"] * 300)),
    ]
    got = {r.doc_id: (r.line, r.family) for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (1, "Apache-2.0"), 2: (0, "MIT"), 3: (0, "proprietary"), 4: (0, "GPL"), 5: (0, "CC-BY-NC"), 6: (0, "unknown"), 11: (0, "MIT")}


def test_odd_rows(spark):
    assert scan_licenses(frame(spark)).count() == 0 and scan_licenses(empty(spark)).count() == 0
    twice = spark.createDataFrame([(None, "All rights reserved.", 1)] * 2, "doc_id long, text string, family int")
    assert scan_licenses(twice).count() == 2


def test_scores_by_a_plain_loop():
    """Probabilities of the sparse vectorised scorer against one paragraph and one word at a time."""
    model = trained()
    texts, _ = _made(random.Random(99), 4)
    parts = [words_of(t) for t in texts] + [[]]
    got = model.probabilities(parts)
    mask = (1 << 64) - 1
    for words, row in zip(parts, got):
        codes = [crc32(w) for w in words]
        features = {(c * 0x9E3779B97F4A7C15 & mask) >> (64 - BITS) for c in codes}
        features |= {((a * 0xD6E8FEB86659FD93 + b) * 0xC2B2AE3D27D4EB4F & mask) >> (64 - BITS) for a, b in zip(codes, codes[1:])}
        scores = [(model.bias[c] + sum(model.weights[model.slot[f], c] for f in features if model.slot[f] >= 0)) / model.temperature for c in range(len(CLASSES))]
        top = max(scores)
        whole = sum(math.exp(x - top) for x in scores)
        assert all(abs(math.exp(x - top) / whole - p) < 1e-9 for x, p in zip(scores, row))


def test_planted_lines(spark):
    """Every line of the documents that speaks of a licence is found, and nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    says = re.compile(r"licen[sc]e|SPDX|all rights reserved|CC[ -]BY|CC0|permission is hereby", re.I)
    planted = {(r.doc_id, n) for r in docs.collect() for n, line in enumerate((r.text or "").split("\n")) if says.search(line)}
    rows = scan_licenses(docs).collect()
    assert {(r.doc_id, r.line) for r in rows} == planted and len(planted) > 30
    assert all(r.similarity >= CONTAINED for r in rows if r.family != "unknown")
