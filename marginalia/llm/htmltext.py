"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

(Lafferty, McCallum and Pereira, 2001.) A block's features are the tags and
class words around it and what its text looks like; labels are main text or
not; Viterbi decoding picks the best labelling of a page's blocks as a chain.
The model is trained here, on pages with known labels made by
:func:`labelled_pages`: layouts of many kinds, with and without semantic tags.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .dom import Block, leaf_blocks
from .frames import column, numbered, schema_of
from .workers import map_arrow

#: Marks main text in training pages; a private-use character.
_MARK = ""
#: Pages that the model is trained on, and rounds of training.
PAGES, ROUNDS = 500, 160


_DIGIT = re.compile(r"\d")


def _bucket(n: int) -> int:
    return min(n.bit_length(), 9)


def text_features(block: Block, place: int, total: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = 4 * block.linked // max(1, len(text))
    last = text[-1]
    return [
        "bias", f"words={_bucket(words)}", f"linked={share}", f"parent={block.parent}", f"stop={last in '.!?:;\"'}", f"comma={',' in text or '. ' in text}",
        f"sign={'\xa9' in text or '\xb7' in text or '|' in text}", f"digits={len(_DIGIT.findall(text)) * 5 > len(text)}",
        f"first={min(place, 3)}", f"last={min(total - 1 - place, 3)}", f"short={words < 4}/{share > 2}",
    ]


def _pseudo_words(rng: random.Random) -> list[str]:
    parts = ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouéöü") for _ in range(rng.randint(1, 2))) for _ in range(40)]
    return ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(150)]


def labelled_pages(pages: int, seed: int = 9) -> list[str]:
    """Training pages; each block of main text holds the mark."""
    rng = random.Random(seed)
    out = []
    for _ in range(pages):
        words = _pseudo_words(rng)

        def say(low: int, high: int) -> str:
            said, left = [], rng.randint(low, high)
            while left > 0:
                n = min(left, rng.randint(3, 16))
                said.append((" ".join(rng.choices(words, k=n))).capitalize() + rng.choice([".", ".", ".", "!", "?", "", "..."]))
                left -= n
            return " ".join(said)

        def links(low: int, high: int, item: str = "li") -> str:
            return "".join(f"<{item}><a href='/{rng.choice(words)}'>{say(1, 3)}</a></{item}>" for _ in range(rng.randint(low, high)))

        def either(tag: str, *names: str) -> tuple[str, str]:
            """The tag with or without a name, or a div with one."""
            kind = rng.random()
            name = rng.choice(names)
            where = rng.choice(["class", "class", "id"])
            if kind < 0.45:
                return f"<{tag}>", f"</{tag}>"
            if kind < 0.6:
                return f'<{tag} {where}="{name}">', f"</{tag}>"
            return f'<div {where}="{name}">', "</div>"

        def box(pair: tuple[str, str], inside: str) -> str:
            return pair[0] + inside + pair[1]

        def paragraph(low: int, high: int, mark: str = "") -> str:
            text = mark + say(low, high)
            if rng.random() < 0.2:
                text = f"<b>{text}" + rng.choice(["</b>", "<br>", ""])
            if rng.random() < 0.1:
                text += f" <a href='#'>{say(1, 3)}</a> {say(1, 6)}"
            return "<p>" + text + rng.choice(["</p>", "</p>", "</p>", ""])

        def plain(tag: str, *names: str) -> tuple[str, str]:
            return f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice(names)}">', f"</{tag}>"

        def chrome(kind: str) -> str:
            if kind == "nav":
                return box(either("nav", "menu", "nav", "navbar", "navigation", "top-links", "breadcrumb"), f"<ul>{links(3, 9)}</ul>" if rng.random() < 0.8 else links(3, 8, "span"))
            if kind == "header":
                return box(either("header", "header", "masthead", "site-header", "banner", "top"), f"<h1>{say(1, 4)}</h1>" * rng.randint(0, 1) + f"<p>{say(2, 9)}</p>" + (f"<ul>{links(2, 5)}</ul>" if rng.random() < 0.5 else ""))
            if kind == "ad":
                return box(plain(rng.choice(["div", "div", "section", "aside"]), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad"), say(4, 30) if rng.random() < 0.6 else paragraph(3, 40))
            if kind == "notice":
                return box(plain(rng.choice(["div", "section"]), "cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe"), paragraph(4, 40) if rng.random() < 0.5 else say(4, 30))
            if kind == "aside":
                return box(either("aside", "sidebar", "related", "widget", "side", "recommended", "trending", "most-read"), f"<h3>{say(1, 4)}</h3>" + (f"<ul>{links(2, 7)}</ul>" if rng.random() < 0.6 else paragraph(5, 50) * rng.randint(1, 2)))
            if kind == "comments":
                who = "".join(f'<div class="comment">{rng.choice(["<h4>" + say(1, 2) + "</h4>", "<b>" + say(1, 2) + "</b>", ""])}{paragraph(3, 60)}</div>' for _ in range(rng.randint(1, 5)))
                return box(plain(rng.choice(["section", "div", "ol"]), "comments", "comment-list", "commentlist", "replies", "discussion", "responses"), f"<h3>{say(1, 3)}</h3>{who}")
            if kind == "form":
                return box(("<form action='/go'>", "</form>"), f"<label>{say(1, 4)}</label><input name='q'><p>{say(2, 20)}</p><button>{say(1, 2)}</button>")
            if kind == "share":
                return box(plain("div", "share", "social", "tags", "meta", "byline", "pagination", "pager"), links(2, 5, "span"))
            return box(either("footer", "footer", "site-footer", "bottom", "copyright", "legal"), f"&copy; {rng.choice(words)}.example &middot; {say(2, 14)}" if rng.random() < 0.6 else f"<p>&copy; 20{rng.randint(10, 25)} {say(2, 20)}</p><ul>{links(0, 5)}</ul>")

        body = []
        if rng.random() < 0.9:
            body.append(f"<h1>{_MARK}{say(2, 14)}</h1>")
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 8, 10, 14])):
            kind = rng.random()
            if kind < 0.75:
                body.append(paragraph(1, 120, _MARK))
            elif kind < 0.85:
                body.append(f"<{rng.choice(['h2', 'h3'])}>{_MARK}{say(1, 8)}</h2>".replace("</h2>", "") + "\n")
                body[-1] = body[-1].rstrip() + body[-1][:3].replace("<", "</") + ">"
            elif kind < 0.92:
                body.append("<ul>" + "".join(f"<li>{_MARK}{say(2, 25)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.96:
                body.append(f"<blockquote>{paragraph(4, 50, _MARK)}</blockquote>")
            else:
                body.append(f"<table><tr><td>{_MARK}{say(1, 4)}</td><td>{_MARK}{say(1, 4)}</td></tr></table>")
            if rng.random() < 0.05:
                body.append(chrome(rng.choice(["ad", "share", "notice", "aside"])))
        if rng.random() < 0.12:
            body.append(chrome(rng.choice(["share", "comments", "form"])))
        holder = rng.random()
        names = ("content", "post", "entry", "article", "story", "article-body", "post-content", "main", "main-content", "entry-content", "page-content", "text")
        main = "".join(body)
        if holder < 0.5:
            main = box(("<article>", "</article>"), main)
        elif holder < 0.65:
            main = box(("<main>", "</main>"), main)
        elif holder < 0.9:
            main = box(plain(rng.choice(["div", "section", "article"]), *names), main)
        if rng.random() < 0.3:
            main = box(plain("div", "container", "wrapper", "page", "row", "layout"), main)
        before = [chrome(k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "aside"], rng.randint(1, 4))]
        after = [chrome(k) for k in rng.sample(["aside", "comments", "ad", "form", "notice", "share", "nav"], rng.randint(0, 4))] + ([chrome("footer")] if rng.random() < 0.9 else [])
        if rng.random() < 0.15:
            before, after = [], []
        inner = "".join([*before, main, *after])
        if rng.random() < 0.2:
            inner = box(plain("div", "container", "wrapper", "page", "site"), inner)
        out.append(f"<!DOCTYPE html><html><head><title>{say(1, 8)}</title><style>p{{}}</style></head><body>{inner}</body></html>")
    return out


class Crf:
    """Two labels; weights by feature, between neighbours, and for a page's first block."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.names, self.weights, self.step, self.first = names, weights, step, first

    @classmethod
    def train(cls, pages: list[list[list[str]]], labels: list[list[int]], rounds: int = ROUNDS, ridge: float = 0.02) -> Crf:
        """Maximum likelihood by Adam; forward and backward sums run over all pages at once."""
        seen: dict[str, int] = {}
        for page in pages:
            for block in page:
                for f in block:
                    seen[f] = seen.get(f, 0) + 1
        names = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
        many, longest = len(pages), max(map(len, pages))
        at = [(p, t, names[f]) for p, page in enumerate(pages) for t, block in enumerate(page) for f in block if f in names]
        page_of, time_of, feature = np.asarray(at).T
        cell = page_of * longest + time_of
        size = np.asarray([len(p) for p in pages])
        alive = np.arange(longest)[None, :] < size[:, None]
        gold = np.zeros((many, longest), np.int64)
        for p, own in enumerate(labels):
            gold[p, : len(own)] = own
        hot = np.eye(2)[gold] * alive[:, :, None]
        w, step, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
        moment = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, step, first)]
        pairs = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum((0, 1))
        for turn in range(1, rounds + 1):
            score = np.stack([np.bincount(cell, w[feature, y], many * longest).reshape(many, longest) for y in (0, 1)], 2)
            alpha, beta = np.empty_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0] + first
            for t in range(1, longest):
                ahead = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + score[:, t]
                alpha[:, t] = np.where(alive[:, t, None], ahead, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                back = np.logaddexp.reduce(step + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(alive[:, t + 1, None], back, 0)
            whole = np.logaddexp.reduce(alpha[:, -1], axis=1)
            belief = np.exp(alpha + beta - whole[:, None, None]) * alive[:, :, None]
            joint = np.exp(alpha[:, :-1, :, None] + step + (score + beta)[:, 1:, None, :] - whole[:, None, None, None]) * alive[:, 1:, None, None]
            off = (belief - hot).reshape(-1, 2)
            slopes = [np.stack([np.bincount(feature, off[cell, y], len(names)) for y in (0, 1)], 1) + ridge * w, joint.sum((0, 1)) - pairs + ridge * step, off.reshape(many, longest, 2)[:, 0].sum(0) + ridge * first]
            for x, slope, m in zip((w, step, first), slopes, moment):
                m[0] += 0.1 * (slope - m[0])
                m[1] += 0.01 * (slope**2 - m[1])
                x -= 0.1 * (m[0] / (1 - 0.9**turn)) / (np.sqrt(m[1] / (1 - 0.99**turn)) + 1e-8)
        return cls(names, w, step, first)

    def label(self, blocks: list[Block]) -> list[bool]:
        """Viterbi decoding: whether each block is main text."""
        if not blocks:
            return []
        lead = (self.weights[:, 1] - self.weights[:, 0]).tolist() if not hasattr(self, "_lead") else self._lead
        self._lead = lead
        names, known = self.names, self.__dict__.setdefault("_around", {})
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = self.first.tolist()
        back = []
        for t, block in enumerate(blocks):
            around = known.get(block.around)
            if around is None:
                around = known[block.around] = sum(lead[names[f]] for f in block.around if f in names)
                if len(known) > 100_000:
                    known.clear()
            score = around + sum(lead[names[f]] for f in text_features(block, t, len(blocks)) if f in names)
            if t:
                from0, from1 = b + s10 > a + s00, b + s11 > a + s01
                back.append((from0, from1))
                a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01)
            b += score
        out = [b > a]
        for from0, from1 in reversed(back):
            out.append(from1 if out[-1] else from0)
        return out[::-1]


def page_features(blocks: list[Block]) -> list[list[str]]:
    return [[*block.around, *text_features(block, t, len(blocks))] for t, block in enumerate(blocks)]


@lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = 9) -> Crf:
    """The model, trained on ``pages`` made pages; the same each time."""
    features, labels = [], []
    for html in labelled_pages(pages, seed):
        blocks = leaf_blocks(html)
        labels.append([int(_MARK in b.text) for b in blocks])
        features.append(page_features([b._replace(text=b.text.replace(_MARK, "") or ".") for b in blocks]))
    return Crf.train(features, labels)


def main_text(html: str | None, model: Crf) -> str:
    if not html:
        return ""
    names = model.names
    blocks = leaf_blocks(html, lambda name: name if name in names else None)
    return "\n".join(b.text for b, main in zip(blocks, model.label(blocks)) if main)


def _extract(model: Crf, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, model) for html in batch.column(len(names) - 2).to_pylist()]
            own = [batch.column(i) for i in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    return run


def extract_text(pages: DataFrame, html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """``pages`` without the html, with text (main blocks joined by \\n; empty if none) and n_chars.

    Null and empty pages give empty text; pages of any length are read whole;
    repeated rows are extracted one by one; an empty table gives an empty
    result; input columns called text or n_chars are replaced, all others kept
    whatever their names.
    """
    carried = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = schema_of(pages, carried, "text string, n_chars long")
    return map_arrow(pages.select(*numbered(carried), column(html_col).alias("html")), _extract(model or trained(), schema.names), schema)
