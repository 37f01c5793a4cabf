"""Documents that every operator has to bear: nulls, empty and very long texts, ties, repeats."""

import random

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def documents(seed: int = 1, many: int = 60) -> list[tuple]:
    """(doc_id, text, source) rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(80)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = "\n".join(line(14) for _ in range(5))
    rows = []
    for i in range(many):
        kind = i % 6
        own = "\n".join(line(rng.randint(1, 20)) for _ in range(rng.randint(1, 8)))
        if kind == 1:
            own = own + "\n" + shared
        elif kind == 2 and rows:
            own = rows[-2][1]
        elif kind == 3 and rows:
            words = rows[-3][1].split(" ")
            words[len(words) // 2] = "changed"
            own = " ".join(words)
        rows.append((i, own, f"src{i % 4}"))
    rows += [(1001, None, "src0"), (1002, "", "src1"), (1003, " \n\t\x0b ", None), (1004, LONG, "src0"), (1005, LONG + " tail", None), (None, "a null id with some words", "src2"), (1006, "one", "src3"), (1007, "Two words", "src3")]
    rows += [rows[3], rows[3], (1008, "naïve ÉTÉ — 東京 <|endoftext|> don't. İstanbul", "src1")]
    return rows


SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
