"""The fuzzy join where strings fill several blocks and what is followed at once has to be cut."""

import random

from marginalia.functions import evidence as E


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_blocks_and_cuts_lose_nothing(spark, monkeypatch):
    for name, value in (("BLOCK_TERMS", 90), ("BLOCK_PROBES", 40), ("TOGETHER", 7)):
        assert getattr(E, name) > value
        monkeypatch.setattr(E, name, value)
    rng = random.Random(11)
    words = sorted({"".join(rng.choice(["a", "b", "ch", "ü", "😀"]) for _ in range(rng.randint(1, 12))) for _ in range(420)})
    rng.shuffle(words)
    left, right = words[:120], words[100:]
    got = E.fuzzy_join(spark.createDataFrame([(x,) for x in left], "probe string"), spark.createDataFrame([(x,) for x in right + right[:9]], "term string")).collect()
    expected = {(a, b, d) for a in left for b in right if 1 - (d := distance(a, b)) / max(len(a), len(b)) >= E.SIMILAR - 1e-9}
    assert {(r.probe, r.term, r.distance) for r in got} == expected and len(got) == len(expected) > 200


def test_what_is_followed_at_once_is_bounded(monkeypatch):
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(300)})
    terms = [w for w in words if len(w) == 7]
    pairs = lambda: {tuple(r) for part in E._pairs(words, terms, E.SIMILAR) for r in part.itertuples(index=False)}
    whole = pairs()
    monkeypatch.setattr(E, "CELLS", 200)
    assert pairs() == whole == {(a, b, d) for a in words for b in terms if 1 - (d := distance(a, b)) / max(len(a), 7) >= E.SIMILAR - 1e-9}
