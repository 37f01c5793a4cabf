"""Ids and offsets of the word cache against encodings of whole texts."""

import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from marginalia.llm.tokencount import encode_chunk
from marginalia.llm.tokens import WordEncoder, chunks, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = list("İıßſŉǰΣσςéÀﬁ'’.,!?;:#$%&*| \n\t") + ["́", "̇", "ͅ"]
POOLS = [
    [chr(c) for c in range(32, 127)], [chr(c) for c in range(0xA0, 0x250)], ODD,
    [chr(c) for c in range(0x250, 0x3000)], [chr(c) for c in range(0x3000, 0x110000) if not 0xD800 <= c < 0xE000],
]
ENDS = ["", "", ".", ",", "!?", "'s", "'LL", " ", "<|endoftext|>"]


def agrees(encoder: WordEncoder, texts: list[str]) -> None:
    ids, first, stop, origin = encode_chunk(encoder, [t.encode() for t in texts])
    k = 0
    for text, whole, o in zip(texts, WHOLE.encode_batch(texts, add_special_tokens=False), origin):
        n = len(whole.ids)
        assert ids[k : k + n].tolist() == whole.ids, repr(text)
        assert list(zip((first[k : k + n] - o).tolist(), (stop[k : k + n] - o).tolist())) == whole.offsets, repr(text)
        k += n
    assert k == len(ids)


def test_case_that_grows_when_lowered():
    agrees(WordEncoder(PATH, offsets=True), ["TARİHİ, İ. İ", "İ", "Ⱥb, Ⱦ.", "ŉ. ǰ!"])


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)

    def word() -> str:
        pool = rng.choices(POOLS, [6, 3, 4, 2, 1])[0]
        return "".join(rng.choice(pool) if rng.random() < 0.9 else rng.choice(ODD) for _ in range(rng.randint(1, 9))) + rng.choice(ENDS)

    encoder = WordEncoder(PATH, offsets=True)
    for _ in range(125):
        agrees(encoder, [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(200)])


def test_all_documents():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    encoder = WordEncoder(PATH, offsets=True)
    for begin, end in chunks([t.encode() for t in texts]):
        agrees(encoder, texts[begin:end])
