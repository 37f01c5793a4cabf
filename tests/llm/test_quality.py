import re
from collections import Counter

import numpy as np

from marginalia.llm.quality import FEATURES, BoostedTrees, base_failed, fit_quality, judge_quality, keep_quality, statistics

from .cases import documents, empty, frame


def plainly(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_base_counts():
    texts = [t for _, t, _ in documents()] + ["a b c d e a b c d e f", "x x x x x x", "é b\x0bc\x1cd\nx\nx\n\n \n", "#a* $%&|<>"]
    got, features = statistics([None if t is None else t.encode() for t in texts])
    assert got.tolist() == [plainly(t) for t in texts]
    assert np.isfinite(features).all() and features.shape[1] == len(FEATURES)


def test_trees_learn_and_keep_their_signs():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) & (np.sin(9 * x[:, 1]) > -0.5)).astype(float)
    model = BoostedTrees([-1, 0, 1], trees=60).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    base = rng.random((200, 3))
    for column, sign in ((0, -1), (2, 1)):
        steps = [model.score(np.where(np.arange(3) == column, v, base)) for v in np.linspace(0, 1, 30)]
        assert (sign * np.diff(np.stack(steps), axis=0) >= -1e-12).all()


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels.where("doc_id % 2 = 0"))
    held = judge_quality(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").toPandas()
    sane = held[~held["base_failed"]]
    assert (sane["kept"] == (sane["quality"] == 1)).mean() > 0.97


def test_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (3, 1), (3, 0)], "doc_id long, quality int")
    model = fit_quality(frame(spark), labels)
    rows = judge_quality(frame(spark), model).collect()
    assert len(rows) == len(documents())
    assert all(not r.kept for r in rows if r.doc_id in (1001, 1002, 1003, 1006))
    kept = keep_quality(frame(spark), model)
    assert kept.columns == frame(spark).columns and kept.count() == sum(r.kept for r in rows)
    none = fit_quality(empty(spark), labels)
    assert judge_quality(empty(spark), none).count() == 0
    assert base_failed(np.asarray([[9, 0, 0, 0, 0], [10, 0, 0, 0, 3], [10, 0, 0, 0, 2]])).tolist() == [True, True, False]


def test_walk_equals_plain_trees():
    """The vectorised walk against one row and one node at a time."""
    rng = np.random.default_rng(5)
    x = rng.random((400, 4))
    model = BoostedTrees([0, -1, 1, 0], trees=30).fit(x, (x[:, 0] * x[:, 3] > 0.3 * x[:, 1]).astype(float))
    for row, got in zip(x, model.score(x)):
        raw = model.bias
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while 2 * node + 1 < len(value):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            raw += value[node]
        assert abs(got - 1 / (1 + np.exp(-raw))) < 1e-9


def test_windows_in_large_groups():
    """Window keys stay exact where documents and words are many."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 4, 60)) + " " + " ".join(f"d{i}x{k}" for k in range(40)) for i in range(900)]
    assert statistics([t.encode() for t in texts])[0].tolist() == [plainly(t) for t in texts]


def test_clashing_names(spark):
    text = " ".join(f"plain{i} words{i}." for i in range(100))
    names = ["doc_id", "__text", "text", "c0", "a.b", "label"]
    docs = spark.createDataFrame([(1, "X", text, 1, 2, "y")], names)
    model = fit_quality(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [tuple(r) for r in keep_quality(docs, model).collect()] == [(1, "X", text, 1, 2, "y")]
    got = judge_quality(docs, model, carry=("__text", "a.b"))
    assert got.columns[:3] == ["__text", "a.b", "n_words"] and got.first().n_words == 200
