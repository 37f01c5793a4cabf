import base64
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from marginalia.llm import align
from marginalia.llm.align import UnitIds, align_tokenizers, group_tokens, linked_pairs
from marginalia.llm.tokens import tokenizer_path

from .cases import SCHEMA, documents

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """Both sides' (id, bytes) of whole texts, straight from the libraries; byte strings from the rank file."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb"))}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    def run(text):
        a = [(i, ranks[i]) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in two.encode(text)]
        spelled = (" " + text).encode()
        return (a, b) if text and b"".join(x for _, x in a) == spelled == b"".join(x for _, x in b) else ([], [])

    return run


def groups_of(a, b):
    """Tokens of both sides taken one at a time, the side that is behind first; a group ends where both stand at one byte."""
    out, left, right, i, j, x, y = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            left.append(a[i][0])
            x += len(a[i][1])
            i += 1
        else:
            right.append(b[j][0])
            y += len(b[j][1])
            j += 1
        if x == y:
            out.append((left, right))
            left, right = [], []
    assert not left and not right
    return out


def plainly(rows, whole):
    held, counts = [], Counter()
    for doc_id, text, *_ in rows:
        a, b = whole(text or "")
        groups = groups_of(a, b)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        counts.update(links.keys())
        held.append((doc_id, a, b, groups, links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for doc_id, a, b, groups, links in held:
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        best = sum(m for p, m in links.items() if counts[p] == most[p[0]])
        out.append((doc_id, len(a), len(b), len(groups), sum(links.values()), best, sum(m * counts[p] for p, m in links.items()), sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


ODD = ["  two blanks  inside \n\n new\nline ", "▁ is a blank on one side", "a\x00b \x1c x\x85y", "aaaa" * 900, "日本語 テキスト、 mixed with English", "<|endoftext|> <s> </s> <0x41>", " ", "\n", "ﬁ ﬂ é 　 wide", "🙂🙂 👩‍👩‍👧 x", "x" * 3 + " " * 40 + "y", "it's don 't 's", "▁"]


@pytest.mark.parametrize("listed", [None, 2])
def test_documents(spark, whole, monkeypatch, listed):
    if listed:  # groups by their different ids
        monkeypatch.setattr(align, "LISTED_LINKS", listed)
    rows = documents() + [(3000 + i, x, None) for i, x in enumerate(ODD)]
    got = align_tokenizers(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plainly(rows, whole)
    none = {r.doc_id: r for r in got.collect()}
    assert none[1001].n_a == none[1002].n_groups == none[3001].n_b == 0 and none[3001].groups_sha256 == ""


def test_units_spell_whole_texts(whole, monkeypatch):
    """Ids of units in a row are those of the whole text, for texts of odd characters and a cache that starts anew."""
    monkeypatch.setattr(align, "MAX_UNITS", 500)
    rng = random.Random(3)
    atoms = [" ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'", "a", "Bc", "été", "12", "٣", "日", "🙂", ".", "--", "é", "​", "▁", "<s>", "\r\n", "x\x00"]
    cache = UnitIds(A, B)
    for _ in range(4000):
        text = "".join(rng.choices(atoms, k=rng.randint(1, 14)))
        at = cache.look_up(align.BETWEEN.split(text))
        a, b = whole(text)
        if cache.right[at].all():
            assert [i for i, _ in a] == cache.tokens(at, 0)[0].tolist() and [i for i, _ in b] == cache.tokens(at, 1)[0].tolist(), repr(text)
        else:
            assert not a and not b


def test_large_group():
    """A group without an inner cut, of tokens by the hundred thousand, is counted by its ids."""
    a, b = np.repeat([3, 5], 60_000), np.repeat([1, 2, 9], 30_000)
    who, pair, links = linked_pairs(a, b, np.asarray([len(a)]), np.asarray([len(b)]), np.asarray([0]), 10, 100)
    assert pair.tolist() == [31, 32, 39, 51, 52, 59] and set(links.tolist()) == {60_000 * 30_000} and not who.any()
    of_a, of_b, cut = group_tokens(np.asarray([2, 4, 9]), np.asarray([4, 6, 9]))
    assert of_a.tolist() == [0, 0, 1] and of_b.tolist() == [0, 1, 1] and np.flatnonzero(cut).tolist() == [4, 9]


def test_odd_tables(spark):
    assert align_tokenizers(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    names = ["doc_id", "text", "own", "pair", "pairs", "links", "n", "a.b", "best", "n_a"]
    out = align_tokenizers(spark.createDataFrame([(1, "one two", 1, 2, 3, 4, 5, 6, 7, 8)] * 2, names), A, B).collect()
    assert len(out) == 2 and all(r.n_groups == 2 and r.n_best == r.n_links and r.count_sum == 4 for r in out)
    assert align_tokenizers(spark.createDataFrame([(None, None, None)], SCHEMA), A, B).first().n_a == 0
