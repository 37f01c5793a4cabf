"""Licence notices found by a trained paragraph classifier and confirmed by templates.

Paragraphs are the lines of a text, and adjacent lines over which a template is
wrapped. Hashed word unigrams and bigrams go into a
sparse multinomial logistic regression over licence families, "none" and
"unknown" (a licence of no known family). Its probabilities are calibrated by a
temperature fitted on held-out paragraphs. A family's prediction stands only if
one of its templates is contained in the paragraph; else the notice is unknown.
Training paragraphs are made from the templates, from invented licence names
and from prose that merely uses such words.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tokens import chunks, column_bytes
from .workers import map_arrow

BITS = 18
#: Share of a template's bigrams that a confirmed paragraph holds, and calibrated probability that a notice needs.
CONTAINED, SURE = 0.7, 0.6

# Wordings by which licences are commonly granted.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the Apache License",
        "released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "distributed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
        "released under the BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "licensed under the GNU General Public License, version 3",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "released under the GNU GPL version 2",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL": [
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "subject to the terms of the Mozilla Public License, version 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "EPL": [
        "made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
        "available under the Creative Commons Attribution License",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "available under the Creative Commons Attribution-ShareAlike License",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC-ND 4.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain",
        "dedicated to the public domain under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ],
    "proprietary": [
        "All rights reserved",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited",
        "No part of this publication may be reproduced without the prior written permission of the publisher",
    ],
}
# Sentences that use the words of licences without granting one.
DECOYS = [
    "He lost his driving license on the way to the harbour", "She is a licensed pilot and teaches under supervision", "The Apache helicopter landed near the river at noon",
    "Researchers at MIT released a study about general public health", "The general public was not allowed into the hall", "The library is open to the public free of charge on Sundays",
    "A creative commons for painters opened in the old mill", "Attribution of the portrait to the master is in doubt", "The foundation published the terms of the prize",
    "Civil rights were reserved for citizens in those years", "The eclipse was visible from the public square", "They distribute copies of the leaflet for any purpose they like",
    "The domain of public finance was reformed in version two of the bill", "All of the rooms were reserved for the guests", "Modification of the source of the stream changed the binary star survey",
    "Permission to leave was granted by the officer", "The software of the lift failed and the terms were disputed", "The fishing licence has to be renewed every year",
    "Mozilla is a person in the novel", "The lesser general rode in front of the greater one", "The affair was published in the news with the names changed",
]
CLASSES = ["none", "unknown", *TEMPLATES]

_CLEAN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(paragraph: bytes) -> list[bytes]:
    """Lower-case words; ASCII other than letters and digits separates them."""
    return paragraph.lower().translate(_CLEAN).split()


def grams(paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, feature) of all word unigrams and bigrams; repeated ones come again."""
    count = np.asarray([len(p) for p in paragraphs], np.int64)
    value = np.fromiter(map(crc32, (w for p in paragraphs for w in p)), np.uint64, int(count.sum()))
    own = np.repeat(np.arange(len(paragraphs)), count)
    with np.errstate(over="ignore"):
        one = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        two = ((value[:-1] * np.uint64(0xD6E8FEB86659FD93) + value[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    near = np.flatnonzero(own[:-1] == own[1:])
    return np.concatenate([own, own[near]]), np.concatenate([one, two[near]]).astype(np.int64)


def _made(rng: random.Random, each: int) -> tuple[list[bytes], list[int]]:
    """Training paragraphs and their classes."""
    plain = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one were all their there been has when who more no if out so said what up its about into than them can only other new some time could these two may then do first any now such like our over man me even most made after also did many before must through".split()
    letters = "abcdefghijklmnoprstuvwxyz"

    def word(common: float) -> str:
        return rng.choice(plain) if rng.random() < common else "".join(rng.choices(letters, k=rng.randint(2, 10)))

    def prose(low: int, high: int) -> str:
        common = rng.choice([0, 0, 0.2, 0.5])  # other languages have none of the frequent words
        return " ".join(word(common) for _ in range(rng.randint(low, high)))

    def around(text: str) -> str:
        kind = rng.random()
        before = "" if kind < 0.5 else rng.choice(["This work is ", "This project is ", "Copyright (c) 2019 by the authors. ", "The code is ", prose(1, 40) + ". "])
        return before + text + rng.choice([".", "", ".", ". " + prose(1, 40) + "."])

    def worn(text: str) -> str:
        kept = text.split()
        if len(kept) > 5 and rng.random() < 0.3:
            del kept[rng.randrange(len(kept))]
        return " ".join(kept)

    texts, labels = [], []
    for family, templates in TEMPLATES.items():
        for _ in range(each):
            texts.append(around(worn(rng.choice(templates))))
            labels.append(CLASSES.index(family))
    for _ in range(3 * each):
        name = " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))).capitalize() for _ in range(rng.randint(1, 2)))
        texts.append(around(rng.choice([
            f"Licensed under the {name} License, version {rng.randint(1, 5)}", f"released under the {name} Public License", f"under the terms of the {name} license", f"Use of this work is governed by the {name} licence agreement",
            f"SPDX-License-Identifier: LicenseRef-{name}", f"distributed under the {name} Community License {rng.randint(1, 4)}.0",
        ])))
        labels.append(1)
    for _ in range(20 * each):
        texts.append(rng.choice([prose(1, 200), prose(1, 30), prose(0, 20) + " " + rng.choice(DECOYS) + ". " + prose(0, 60), rng.choice(DECOYS)]))
        labels.append(0)
    return [t.encode() for t in texts], labels


class LicenseModel:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        #: Rows of features that count; ``slot`` is a feature's row, or -1.
        self.slot = np.full(1 << BITS, -1, np.int32)
        used = np.flatnonzero(np.abs(weights).max(1) > 1e-3)
        self.slot[used] = np.arange(len(used))
        self.weights, self.bias, self.temperature = weights[used], bias, temperature
        self.templates = {c: [self._bigrams(words_of(t.encode())) for t in own] for c, own in TEMPLATES.items()}
        self.known = frozenset().union(*(t for own in self.templates.values() for t in own))
        self.longest = max(len(words_of(t.encode())) for own in TEMPLATES.values() for t in own)

    @staticmethod
    def _bigrams(words: list[bytes]) -> frozenset:
        return frozenset(zip(words, words[1:]))

    def probabilities(self, paragraphs: list[list[bytes]], raw: bool = False) -> np.ndarray:
        own, feature = grams(paragraphs)
        slot = self.slot[feature]
        known = slot >= 0
        pair = np.unique(own[known] * len(self.weights) + slot[known])  # a feature counts once a paragraph
        own, slot = pair // max(1, len(self.weights)), pair % max(1, len(self.weights))
        score = np.stack([np.bincount(own, self.weights[slot, c], len(paragraphs)) for c in range(len(CLASSES))], 1) + self.bias
        score = score if raw else score / self.temperature
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def similarity(self, family: str, words: list[bytes]) -> float:
        """Largest share of a template of the family that the paragraph contains."""
        have = self._bigrams(words)
        return max(len(t & have) / len(t) for t in self.templates[family])

    def wrapped(self, lines: list[list[bytes]]) -> Iterator[tuple[int, int]]:
        """(first, last) of adjacent lines over which a template is spread, and which all add to what they hold of it.

        A template that begins in a line ends within as many words after it as
        the longest template has; so do windows, however short their lines are.
        """
        seen = set()
        for i, line in enumerate(lines):
            j, after = i, 0
            while j + 1 < len(lines) and after < self.longest:
                j += 1
                after += len(lines[j])
            if j == i:
                continue
            have = self._bigrams(self.span(lines, i, j)) & self.known
            for t in (t for own in self.templates.values() for t in own) if len(have) > 1 else ():
                held = len(t & have)
                if held < CONTAINED * len(t):
                    continue
                a, b = i, j
                while a < b and len(t & self._bigrams(self.span(lines, a, b - 1))) == held:
                    b -= 1
                while a < b and len(t & self._bigrams(self.span(lines, a + 1, b))) == held:
                    a += 1
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    yield a, b

    def span(self, lines: list[list[bytes]], first: int, last: int) -> list[bytes]:
        """Words of adjacent lines: of the outer ones those that a template over the breaks can reach."""
        if first == last:
            return lines[first]
        return [*lines[first][-self.longest :], *(w for own in lines[first + 1 : last] for w in own), *lines[last][: self.longest]]

    def decide(self, paragraphs: list[list[bytes]]) -> Iterator[tuple[int, str, float, float]]:
        """(paragraph, family, probability, similarity) of those with a notice."""
        p = self.probabilities(paragraphs)
        for i in np.flatnonzero(p[:, 0] < 1 - SURE).tolist():
            best = int(p[i, 1:].argmax()) + 1
            family, similarity = CLASSES[best], 0.0
            if best > 1:
                similarity = self.similarity(family, paragraphs[i])
                if p[i, best] < SURE or similarity < CONTAINED:
                    family = "unknown"
            yield i, family, float(p[i, best]), similarity


@lru_cache(maxsize=1)
def trained(each: int = 100, rounds: int = 80, seed: int = 8) -> LicenseModel:
    """The model, fitted on made paragraphs; every fifth is held out for the temperature. The same each time."""
    texts, labels = _made(random.Random(seed), each)
    parts = [words_of(t) for t in texts]
    y = np.eye(len(CLASSES))[labels]
    own, feature = grams(parts)
    pair = np.unique(own * (1 << BITS) + feature)
    own, feature = pair >> BITS, pair & ((1 << BITS) - 1)
    names, at = np.unique(feature, return_inverse=True)
    fit = np.arange(len(texts)) % 5 > 0
    w, bias = np.zeros((len(names), len(CLASSES))), np.zeros(len(CLASSES))
    # Features seen once in training carry no rule.
    rare = np.bincount(at, minlength=len(names)) < 3
    moment = [np.zeros_like(w), np.zeros_like(w)]

    def scores() -> np.ndarray:
        return np.stack([np.bincount(own, w[at, c], len(texts)) for c in range(len(CLASSES))], 1) + bias

    def softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for turn in range(1, rounds + 1):
        off = (softmax(scores()) - y) * fit[:, None]
        slope = np.stack([np.bincount(at, off[own, c], len(names)) for c in range(len(CLASSES))], 1) + 0.3 * w
        moment[0] += 0.1 * (slope - moment[0])
        moment[1] += 0.01 * (slope**2 - moment[1])
        w -= 0.08 * (moment[0] / (1 - 0.9**turn)) / (np.sqrt(moment[1] / (1 - 0.99**turn)) + 1e-8)
        w[rare] = 0
        bias -= 5 * off.mean(0)
    held = scores()[~fit]
    loss = {t: -np.log(softmax(held / t)[y[~fit] > 0] + 1e-12).mean() for t in np.arange(0.5, 4.01, 0.25)}
    whole = np.zeros((1 << BITS, len(CLASSES)))
    whole[names] = w
    return LicenseModel(whole, bias, float(min(loss, key=loss.get)))


def _notices(model: LicenseModel, lines: list[tuple[int, int, bytes]], words: list[list[bytes]], alone: dict[int, list]) -> list[tuple[int, int, list]]:
    """(first line, last line, what was found) of single lines with a notice and of notices wrapped over lines.

    Wrapped ones may not overlap, the surest template first, and take the place
    of unknown notices in their lines; a family that one of the lines confirms
    by itself is not found again.
    """
    spans, begin = [], 0
    for end in range(1, len(lines) + 1):
        if end == len(lines) or lines[end][:2] != (lines[end - 1][0], lines[end - 1][1] + 1):  # another text, or blank lines between
            if end - begin > 1:
                spans += [(begin + a, begin + b) for a, b in model.wrapped(words[begin:end])]
            begin = end
    judged = [(*spans[i], found) for i, *found in model.decide([model.span(words, a, b) for a, b in spans])] if spans else []
    chosen, taken = [], set()
    for a, b, found in sorted(judged, key=lambda x: (x[2][0] == "unknown", -x[2][2], -x[2][1], x[1] - x[0], x[0])):
        own = range(a, b + 1)
        families = {alone[i][0] for i in own if i in alone}
        if taken.isdisjoint(own) and found[0] not in families and not (found[0] == "unknown" and families):
            chosen.append((a, b, found))
            taken.update(own)
    return sorted([*((i, i, found) for i, found in alone.items() if i not in taken or found[0] != "unknown"), *chosen], key=lambda x: x[:2])


def _scan(model: LicenseModel):
    names = ["doc_id", "line", "family", "probability", "similarity", "paragraph"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), column_bytes(batch, "text"), []
            for begin, end in chunks(texts):
                lines = [(k, n, line) for k in range(begin, end) for n, line in enumerate(texts[k].split(b"\n") if texts[k] else ()) if line.strip()]
                words = [words_of(line) for _, _, line in lines]
                alone = {i: found for i, *found in model.decide(words)} if lines else {}
                for first, last, found in _notices(model, lines, words, alone):
                    k, n, _ = lines[first]
                    family, probability, similarity = found
                    rows.append((ids[k], n, family, round(probability, 6), round(similarity, 6), b"\n".join(line for _, _, line in lines[first : last + 1]).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """doc_id, line, family, probability, similarity, paragraph: a row for each paragraph with a licence notice.

    ``line`` is the \\n-split line's number from 0, of a notice wrapped over adjacent lines the first's. A wrapped notice
    counts if a template is spread over its lines; one of no known family is seen line by line. Null and empty texts have no
    notices; repeated rows and null ids are scanned row by row; an empty table
    gives an empty result; other columns take no part.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_arrow(rows, _scan(model or trained()), "doc_id long, line int, family string, probability double, similarity double, paragraph string")
