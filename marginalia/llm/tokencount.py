"""Token counts of sections, from one encoding of each whole document.

The encoding gives every token its character span; sections are character spans
too, and the two are joined as intervals. A token that crosses a boundary goes
to the section that holds one character of it, by rule: its ``first``, its
``last``, or its ``middle`` one, which is the section with most of the token,
the earlier one among equals. Anchors come in order, so a section's tokens are
one range of them, found by binary search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import column, pack, unpack
from .tokens import WordEncoder, chunks, column_bytes
from .workers import map_arrow

RULES = ("first", "middle", "last")
SECTIONS = "array<struct<section:string,start:bigint,stop:bigint>>"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def edge_sections(text: Column, edge: int = 256) -> Column:
    """Head, body and tail of a text: its first and last ``edge`` characters and what lies between; empty ones are left out."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    head, tail = F.least(n, F.lit(edge)), F.greatest(n - edge, F.least(n, F.lit(edge)))
    parts = [F.struct(F.lit(name).alias("section"), a.cast("long").alias("start"), b.cast("long").alias("stop")) for name, a, b in (("head", F.lit(0), head), ("body", head, tail), ("tail", tail, n))]
    return F.filter(F.array(*parts), lambda s: s["start"] < s["stop"])


def line_sections(text: str) -> Iterator[tuple[str, int, int]]:
    """The \\n-split lines of a text, each with its line end, named by their numbers from 0."""
    start = 0
    for i, line in enumerate(text.split("\n")):
        stop = min(start + len(line) + 1, len(text))
        if start < stop:
            yield str(i), start, stop
        start = stop


def encode_chunk(encoder: WordEncoder, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first characters, ends, and each text's first character) of all tokens, in characters of the joined texts."""
    joined = b"\n".join(text or b"" for text in texts)
    raw = np.frombuffer(joined, np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    solid = ~_SPACE[raw]
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])) if len(raw) else np.zeros(0, np.int64)
    flat, count = encoder.tokens(encoder.look_up(joined.split()))
    base = np.repeat(char[begins] if len(begins) else begins, count)
    size = np.asarray([len(text or b"") + 1 for text in texts])
    at = np.cumsum(size) - size
    firsts = np.append(char, len(char) and char[-1] + 1)[np.minimum(at, len(raw))]
    return flat[0], base + flat[1], base + flat[2], firsts


def _attribute(path: str, rule: str, cut: Callable[[str], Iterable[tuple[str, int, int]]] | None):
    names = ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path, offsets=True)
        for batch in batches:
            ids, texts, sections = batch.column(0).to_pylist(), column_bytes(batch, "text"), batch.column(2)
            for begin, end in chunks(texts):
                _, first, stop, origin = encode_chunk(encoder, texts[begin:end])
                anchor = first if rule == "first" else stop - 1 if rule == "last" else (first + stop - 1) // 2
                upto = np.append(origin, np.iinfo(np.int64).max)
                if cut is None:
                    part = sections.slice(begin, end - begin).to_pylist()
                else:
                    part = [[dict(zip(names[1:4], s)) for s in cut(text.decode())] if text else None for text in texts[begin:end]]
                own = [(k, s) for k, found in enumerate(part) for s in found or ({"section": None, "start": None, "stop": None},)]
                low = np.asarray([origin[k] + (s["start"] or 0) for k, s in own], np.int64)
                high = np.asarray([upto[k + 1] if s["stop"] is None else min(origin[k] + s["stop"], upto[k + 1]) for k, s in own], np.int64)
                a, b = np.searchsorted(anchor, low), np.searchsorted(anchor, high)
                b = np.maximum(a, b)
                # Of a section's tokens, those that start before it are its first ones, those that end after it its last.
                early = np.clip(np.searchsorted(first, low) - a, 0, b - a)
                late = np.clip(b - np.maximum(a, np.searchsorted(stop, high, "right")), 0, b - a)
                both = (early > 0) & (late > 0) & (early + late > b - a)
                crossing = np.where(both, b - a, early + late)
                columns = [[ids[begin + k] for k, _ in own], *([s[n] for _, s in own] for n in names[1:4]), b - a, crossing]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def count_tokens(
    docs: DataFrame, tokenizer: str, sections: Column | Callable[[str], Iterable[tuple[str, int, int]]] | None = None,
    rule: str = "middle", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, section, start, stop, n_tokens, n_crossing: a row for each section of each document.

    ``sections`` is a column of (section, start, stop) spans in characters, stop
    not included, or a function that cuts a text into such spans, as
    :func:`line_sections`; they may overlap, and each counts on its own. n_crossing is
    how many of the section's tokens reach beyond it. A document without
    sections, as null and empty texts are, gives one row with a null section and
    all its tokens. Repeated rows and null ids are counted row by row; an empty
    table gives an empty result. ``tokenizer`` is the vocabulary file's path.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    text, cut = column(text_col), None if sections is None or isinstance(sections, Column) else sections
    spans = (edge_sections(text) if sections is None else F.lit(None) if cut else sections).cast(SECTIONS)
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), text.alias("text"), spans.alias("sections"))
    return map_arrow(rows, _attribute(tokenizer, rule, cut), "doc_id long, section string, start long, stop long, n_tokens long, n_crossing long")


def with_sections(docs: DataFrame, frame: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``sections`` gathered from (id, section, start, stop) rows, in order of their starts.

    Null ids have no sections; a column of that name is replaced, all others are kept.
    """
    spans = frame.groupBy(column(id_col).alias("of_id")).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "section"))).alias("spans"))
    joined = pack(docs).join(spans, F.col("row")[id_col] == F.col("of_id"), "left")
    ordered = F.transform("spans", lambda s: F.struct(s["section"].cast("string").alias("section"), s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop")))
    return unpack(joined, docs.columns, {"sections": ordered})
