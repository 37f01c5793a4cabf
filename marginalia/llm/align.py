"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A whole Arrow batch of documents is one run of bytes; token lengths, summed
up, are the byte offsets at which the tokens of A and of B end. One bincount
for each side marks these ends, both sides cut where they coincide, and the
running sum of the cuts numbers the groups. Differences of running sums at the
documents' own offsets give each document its counts back.

Ids come from a cache of units, the pieces of a text between single blanks
that have other characters than white space on both sides. Both tokenizers
always end a token there: A's pre-tokenizer starts one at a blank before such
a character, and no piece of B has a blank after another character (checked
when the vocabulary is read). A unit's ids are so the ids of that part of the
whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .frames import column, join_counted
from .store import materialize, rows_per_batch, scratch
from .tokens import chunks
from .workers import TEXTS_PER_BATCH, map_arrow

#: Between two units: a single blank with no white space beside it.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Units, and their tokens, that a worker remembers; beyond that it starts anew.
MAX_UNITS, MAX_UNIT_TOKENS = 300_000, 8_000_000
#: Links of a group that are listed one by one; a larger group's are counted by its different ids.
LISTED_LINKS = 1 << 16


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """Side A: a byte-level BPE; a unit is encoded with a blank before it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab, of = self.tokenizer.get_vocab(with_added_tokens=True), _byte_of()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + unit for unit in units], add_special_tokens=False)]


class PieceTokens:
    """Side B: a sentencepiece model, which adds the blank itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        if any(re.search("[^▁]▁", piece) for piece in pieces):
            raise ValueError(f"a piece of {path} goes on after a blank: units cannot be encoded apart")
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(piece)) else piece.replace("▁", " ").encode() for piece in pieces]

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.processor.encode(units, num_threads=1)


class UnitIds:
    """Ids of units on both sides, and whether the tokens' bytes are the unit's on both."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = (ByteTokens(a_path), PieceTokens(b_path))
        self.width = tuple(np.asarray([len(x) for x in side.bytes], np.int64) for side in self.sides)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.first, self.count, self.flat = ([np.zeros(1024, np.int64) for _ in range(2)] for _ in range(3))
        self.right = np.zeros(1024, bool)
        self.used = [0, 0]

    def _add(self, units: list[str]) -> None:
        k, n = len(self.index), len(units)
        if k + n > len(self.right):
            grow = lambda x: np.concatenate([x, np.zeros(k + 2 * n, x.dtype)])
            self.right, self.first, self.count = grow(self.right), [*map(grow, self.first)], [*map(grow, self.count)]
        right = np.ones(n, bool)
        for s, side in enumerate(self.sides):
            found = side.encode(units)
            size = np.fromiter(map(len, found), np.int64, n)
            total = int(size.sum())
            if self.used[s] + total > len(self.flat[s]):
                self.flat[s] = np.concatenate([self.flat[s], np.zeros(self.used[s] + 2 * total, np.int64)])
            self.flat[s][self.used[s] : self.used[s] + total] = [i for ids in found for i in ids]
            self.first[s][k : k + n] = self.used[s] + np.cumsum(size) - size
            self.count[s][k : k + n] = size
            self.used[s] += total
            right &= np.fromiter((b"".join([side.bytes[i] for i in ids]) == b" " + unit.encode() for ids, unit in zip(found, units)), bool, n)
        self.right[k : k + n] = right
        self.index.update(zip(units, range(k, k + n)))

    def look_up(self, units: list[str]) -> np.ndarray:
        if len(self.index) > MAX_UNITS or max(self.used) > MAX_UNIT_TOKENS:
            self.clear()
        at = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._add(list(dict.fromkeys([units[i] for i in missing])))
            at[missing] = [self.index[units[i]] for i in missing]
        return at

    def tokens(self, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units in a row, tokens of each unit)."""
        count = self.count[side][at]
        begin = np.cumsum(count) - count
        return self.flat[side][np.repeat(self.first[side][at] - begin, count) + np.arange(int(count.sum()))], count


def _at(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running sums (without the element itself) at these places."""
    return np.concatenate([[0], sums])[at]


def group_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ends of both sides' tokens -> (group of each A token, group of each B token, whether a byte offset is a cut)."""
    total = int(ends_a[-1]) if len(ends_a) else 0
    cut = (np.bincount(ends_a, minlength=total + 1) > 0) & (np.bincount(ends_b, minlength=total + 1) > 0)
    before = np.cumsum(cut) - cut
    return before[ends_a], before[ends_b], cut


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, k: np.ndarray, n: np.ndarray, owner: np.ndarray, size_b: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, links) of each document's different pairs; group g has the next k[g] of ids_a and n[g] of ids_b, a pair is a * size_b + b."""
    first_a, first_b = np.cumsum(k) - k, np.cumsum(n) - n
    few = k * n <= LISTED_LINKS
    of_a = np.repeat(np.arange(len(k)), k)
    use = few[of_a]
    times = n[of_a[use]]
    begin = np.cumsum(times) - times
    b_at = np.repeat(first_b[of_a[use]] - begin, times) + np.arange(int(times.sum()))
    key = np.repeat(owner[of_a[use]] * span + ids_a[use] * size_b, times) + ids_b[b_at]
    keys, links = np.unique(key, return_counts=True)
    for g in np.flatnonzero(~few):
        a, na = np.unique(ids_a[first_a[g] : first_a[g] + k[g]], return_counts=True)
        b, nb = np.unique(ids_b[first_b[g] : first_b[g] + n[g]], return_counts=True)
        keys = np.concatenate([keys, (owner[g] * span + a[:, None] * size_b + b).ravel()])
        links = np.concatenate([links, (na[:, None] * nb).ravel()])
    if not few.all():
        keys, place = np.unique(keys, return_inverse=True)
        links = np.bincount(place, links, minlength=len(keys)).astype(np.int64)
    return keys // span, keys % span, links


def _written(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, k: np.ndarray, n: np.ndarray, stops: np.ndarray) -> list[str]:
    """Each document's groups as `a1,a2|b1;a3|b2,b3`; ``stops`` are the ends of the documents' groups."""
    total = len(ids_a) + len(ids_b)
    before_a, before_b = np.cumsum(k) - k, np.cumsum(n) - n
    ids, after = np.empty(total, np.int64), np.zeros(total, np.int8)
    ids[np.arange(len(ids_a)) + before_b[of_a]] = ids_a
    ids[np.arange(len(ids_b)) + (before_a + k)[of_b]] = ids_b
    after[np.cumsum(k) + before_b - 1] = 1
    after[np.cumsum(k) + np.cumsum(n) - 1] = 2
    # The mark after a document's last group ends the document.
    last = np.cumsum(k + n)[stops[stops > 0] - 1] - 1 if len(k) else np.zeros(0, np.int64)
    after[last] = 3
    marks = np.asarray([",", "|", ";", ""])[after].tolist()
    parts = [x for pair in zip(map(str, ids.tolist()), marks) for x in pair]
    out, at = [], 0
    for end in np.concatenate([[0], np.cumsum(k + n)])[stops].tolist():
        out.append("".join(parts[2 * at : 2 * end]))
        at = end
    return out


_SCHEMA = "own long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, row = UnitIds(a_path, b_path), TaskContext.get().partitionId(), 0
        size_b = len(cache.width[1])
        span = len(cache.width[0]) * size_b
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in chunks(texts):  # characters, which bound bytes within a factor of four
                split = [BETWEEN.split(text) if text else [] for text in texts[begin:end]]
                units = np.fromiter(map(len, split), np.int64, len(split))
                at = cache.look_up([unit for own in split for unit in own])
                del split
                doc = np.repeat(np.arange(len(units)), units)
                wrong = np.bincount(doc, ~cache.right[at], minlength=len(units)) > 0
                at, doc = at[~wrong[doc]], doc[~wrong[doc]]
                ids, ends, size = [], [], []
                for side in (0, 1):
                    own, count = cache.tokens(at, side)
                    ids.append(own)
                    ends.append(np.cumsum(cache.width[side][own]))
                    size.append(np.bincount(doc, count, minlength=len(units)).astype(np.int64))
                of_a, of_b, cut = group_tokens(*ends)
                # A document's bytes end where its last token of A does; the cuts up to there are its own and its predecessors'.
                stop = _at(ends[0], np.cumsum(size[0]))
                stops = np.concatenate([np.zeros(1, np.int64), np.cumsum(cut)])[stop + 1] if len(cut) else np.zeros(len(units), np.int64)
                groups = int(cut.sum())
                k, n = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
                n_groups = np.diff(stops, prepend=0)
                n_links = np.diff(_at(np.cumsum(k * n), stops), prepend=0)
                owner = np.repeat(np.arange(len(units)), n_groups)
                who, pair, links = linked_pairs(*ids, k, n, owner, size_b, span)
                texts_of = _written(*ids, of_a, of_b, k, n, stops)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(units)))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.int64(part) << 33) + row + np.arange(len(units))), batch.column(0).slice(begin, end - begin), pa.array(size[0]), pa.array(size[1]), pa.array(n_groups), pa.array(n_links),
                        pa.array([sha256(x.encode()).hexdigest() if x else "" for x in texts_of]), pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(links)),
                    ],
                    ["own", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
                )
                row += len(units)

    return run


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    Side A encodes a blank and the text, side B the text, to which it adds the
    blank; strings of special tokens are plain text. Texts that are null,
    empty, or not spelled by the bytes of either side's tokens have no tokens:
    zeros and ''. Each row is a document, repeated rows and null ids too: a
    pair of ids counts once for each row that holds it linked. n_best counts
    links whose count is the highest of their A id, ties included. An empty
    table gives an empty result; other columns take no part.

    A text's pairs are summed up in the task that reads it. Frequent pairs'
    counts are brought to the documents, at most ten thousand; the others meet
    them by sort and merge, and only those rows are shuffled.
    """
    spark = docs.sparkSession
    size_b = _pieces(b_path)
    skinny = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with scratch(spark):
        with rows_per_batch(spark, TEXTS_PER_BATCH):
            table = materialize(map_arrow(skinny, _aligned(a_path, b_path), _SCHEMA), "align-documents", keep=True)
        counts = materialize(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        a = F.floor(F.col("pair") / F.lit(size_b)).alias("a")  # exact: pairs are far below 2^53
        most = counts.groupBy(a).agg(F.max("n").alias("most"))
        told = counts.select("pair", "n", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
        told = materialize(told, "align-told")
        held = table.select("own", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("own", F.col("x.pairs").alias("pair"), F.col("x.links").alias("m"))
        sums = join_counted(held, told, ["pair"], total).groupBy("own").agg(F.sum(F.col("m") * F.col("best")).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))
        sums = materialize(sums, "align-sums", keep=True)
    zero = F.lit(0).cast("long")
    return (
        table.select("own", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "own", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    )


def _pieces(path: str) -> int:
    return len(PieceTokens(path).bytes)
