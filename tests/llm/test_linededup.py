import random

import pytest

from marginalia.llm.linededup import dedup_lines

from .cases import documents, empty, frame


def brute_force(docs, least):
    """id -> number of deleted lines: all runs of at least so many words, each at its first position and all later ones."""
    first, gone = {}, {d: set() for d, _ in docs}
    for d, text in docs:
        lines = [x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        words = [len(x.encode().split()) for x in lines]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(words[i : j + 1]) < least:
                    continue
                d0, i0 = first.setdefault(tuple(lines[i : j + 1]), (d, i))
                if (d0, i0) != (d, i):
                    gone[d] |= set(range(max(i, i0 + j + 1 - i) if d0 == d else i, j + 1))
    return {d: len(x) for d, x in gone.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_all_windows(spark, seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 3, 6]))) for _ in range(14)] + ["", " "]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 25)))) for i in range(80)]
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()}
    assert got == brute_force(docs, 8)
    assert sum(got.values()) > 100


def test_every_earlier_position_counts(spark):
    """A run that goes on in the second occurrence only is known from there; a run that overlaps itself stays once."""
    run = "\n".join(f"line {i} has ten words in all so that is enough" for i in range(5))
    docs = [(1, run), (2, f"{run}\ntail one two"), (3, f"{run}\ntail one two\nown end"), (4, "\n".join(["ten words of one line that is there many times"] * 40))]
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0, 5, 6, 35] and rows[2].text == "own end"
    assert [r.n_removed for r in rows] == list(brute_force(docs, 50).values())


def test_passage_in_many_documents_stays_once(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    docs = [(i, f"own {i} a\n{passage}\nend {i} b") for i in range(40)]
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_removed for r in rows] == [0] + [1] * 39
    assert rows[7].text == "own 7 a\nend 7 b"


def test_odd_rows(spark):
    rows = {}
    for r in dedup_lines(frame(spark).withColumnRenamed("source", "n_lines")).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert len(rows[3]) == 3 and len({r.text for r in rows[3]}) == 1
    assert rows[1001][0].text is None and rows[1002][0].text == "" and rows[1003][0].n_lines == 0
    assert rows[None][0].n_removed == 0 and rows[1004][0].n_removed == 0
    assert sum(len(r) for r in rows.values()) == len(documents())
    assert dedup_lines(empty(spark)).count() == 0


def test_fingerprints_are_selected_lines(spark):
    """A row for each selected line, fewer than the windows; every window of a shared passage is carried by some row."""
    from marginalia.llm.linededup import fingerprints

    rng = random.Random(2)
    docs = [(i, i, "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(5)) for _ in range(60))) for i in range(20)]
    rows = fingerprints(spark.createDataFrame(docs, "doc_id long, text_hash long, text string"), 50).collect()
    assert len({(r.doc_id, r.fp_at) for r in rows}) == len(rows) < 20 * 60 * 0.3
    assert sum(len(r.starts) for r in rows) == 20 * 51


def test_clashing_names(spark):
    names = ["doc_id", "text", "runs", "text_hash", "of_id", "c0", "__id", "a.b", "row", "n_removed"]
    rows = [(i, "\n".join(f"line {j} of ten words that all the documents do share" for j in range(6)), "r", 1, 2, "c", "d", "e", "f", 9) for i in range(3)]
    got = dedup_lines(spark.createDataFrame(rows, names)).orderBy("doc_id").collect()
    assert got[0].asDict().keys() == set(names) | {"n_lines"}
    assert [r.n_removed for r in got] == [0, 6, 6] and got[2]["a.b"] == "e" and got[2]["runs"] == "r" and got[2]["text"] == ""
