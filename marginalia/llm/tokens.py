"""Encoding of whole texts through a cache of words.

The tokenizer's pre-tokenizer never joins characters across white space, and
its normalizer neither composes nor looks across it, so a text's ids are those
of its words in a row. Most words of a corpus recur: each is encoded once for
each task and looked up from then on. Words of plain letters are encoded many
at a time, and such words with punctuation after them as two units, as the
pre-tokenizer splits there; plain letters are those that no normalizing step
can turn into anything but one letter of as many bytes. All other words are
encoded one by one, whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Punctuation that the pre-tokenizer splits from letters before it, and that begins no special token.
TAIL = b".,!?;:#$%&*|"
#: Words kept; beyond that the cache starts anew, which bounds a worker's memory.
MAX_WORDS = 400_000
#: Texts are handled in groups of about so many bytes.
CHUNK_BYTES = 1 << 19
#: Word that stands for the end of a document; no word holds a blank.
END = b" "


def _plain(c: str) -> bool:
    """Whether NFC and lower-casing keep a letter one letter of as many bytes."""
    lower = c.lower()
    return c.isalpha() and len(lower) == 1 and lower.isalpha() and len(lower.encode()) == len(c.encode()) and unicodedata.normalize("NFC", c) == c


_LETTERS = re.compile("[A-Za-z" + "".join(filter(_plain, map(chr, range(0xC0, 0x250)))) + "]+")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(texts: list[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``size`` bytes each; a longer text is a range of its own."""
    begin = total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if total and total + n > size:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


class WordEncoder:
    """Ids of words and, with ``offsets``, each token's first and last character in its word."""

    def __init__(self, path: str, end_id: int = 1, offsets: bool = False, max_words: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.width = np.zeros(len(self.closes), np.int32)
        for token, i in vocab.items():
            self.closes[i] = token.endswith("</w>")
            self.width[i] = len(token.removesuffix("</w>"))
        self.end_id, self.offsets, self.max_words = end_id, offsets, max_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros((3 if self.offsets else 1, 4096), np.int32)
        self.used = 0
        self._put([END], np.ones(1, np.int64), np.asarray([self.end_id]), np.zeros((2, 1)))

    def _put(self, words: list[bytes], counts: np.ndarray, ids: np.ndarray, spans: np.ndarray) -> None:
        """Appends words whose tokens follow each other in ``ids`` (``spans``: 2 rows of characters)."""
        k, n = len(self.index), len(words)
        if k + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros(k + 2 * n, np.int64)]) for x in (self.first, self.count))
        if self.used + len(ids) > self.flat.shape[1]:
            self.flat = np.concatenate([self.flat, np.zeros((len(self.flat), self.used + 2 * len(ids)), np.int32)], 1)
        self.index.update(zip(words, range(k, k + n)))
        self.count[k : k + n] = counts
        self.first[k : k + n] = self.used + np.cumsum(counts) - counts
        self.flat[0, self.used : self.used + len(ids)] = ids
        if self.offsets:
            self.flat[1:, self.used : self.used + len(ids)] = spans
        self.used += len(ids)

    def _letter_spans(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Character spans of the tokens of plain words, each in its word: a token's bytes are as many as its symbols."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        to = np.cumsum(self.width[ids])
        size = np.asarray([len(word) for word in words])
        origin = np.repeat(char[np.cumsum(size) - size], counts)
        return np.stack([char[to - self.width[ids]] - origin, char[to - 1] + 1 - origin])

    def _add_letters(self, words: list[bytes]) -> None:
        """Words of plain letters: one pre-token each, encoded together and cut after each closing token."""
        ids = np.asarray(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            return self._add_whole(words)
        counts = np.diff(ends, prepend=0)
        self._put(words, counts, ids, self._letter_spans(words, ids, counts) if self.offsets else ids)

    def _add_whole(self, words: list[bytes]) -> None:
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        found = encode([word.decode() for word in words], add_special_tokens=False)
        ids = np.asarray([i for x in found for i in x.ids], np.int64)
        spans = np.asarray([o for x in found for o in x.offsets], np.int64).reshape(-1, 2).T if self.offsets else ids
        self._put(words, np.asarray([len(x.ids) for x in found], np.int64), ids, spans)

    def _add(self, new: set[bytes]) -> None:
        letters, whole, pairs, tails, cores = {}, {}, [], [], []
        index = self.index
        for word in new:
            core = word.rstrip(TAIL)
            if not core.isalpha() and (core.isascii() or not _LETTERS.fullmatch(core.decode())):
                whole[word] = None
            elif len(core) == len(word):
                letters[word] = None
            else:
                tail = word[len(core) :]
                pairs.append(word)
                cores.append(core)
                tails.append(tail)
                if tail not in index:
                    whole[tail] = None
                if core not in index:
                    letters[core] = None
        if letters:
            self._add_letters(list(letters))
        if whole:
            self._add_whole(list(whole))
        if pairs:
            at = np.empty(2 * len(pairs), np.int64)
            at[::2] = [index[core] for core in cores]
            at[1::2] = [index[tail] for tail in tails]
            flat, count = self.tokens(at)
            if self.offsets:
                shift = np.zeros(len(at), np.int64)
                shift[1::2] = [len(core.decode()) for core in cores]
                flat[1:] += np.repeat(shift, count).astype(np.int32)
            self._put(pairs, count[::2] + count[1::2], flat[0], flat[1:])

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the cache, to which unseen words are added."""
        if len(self.index) > self.max_words:
            self.clear()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._add({words[i] for i in missing})
            at[missing] = [self.index[words[i]] for i in missing]
        return at

    def tokens(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``flat`` for all tokens, tokens of each word)."""
        count = self.count[at]
        begin = np.cumsum(count) - count
        total = int(count.sum())
        return self.flat[:, np.repeat(self.first[at] - begin, count) + np.arange(total)], count
