"""Leaf blocks of HTML pages: runs of text between block-level tags, with what encloses them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape
from typing import NamedTuple

#: A name, and a value after =; quotes open a value directly after = and nowhere else.
_ONE = r"[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?"
_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/]+|{_ONE})*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Tags inside a run of text, formulas and drawings with their parts included.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark nobr noscript object picture q s samp small span strike strong sub sup time tt u var video wbr".split()
) | frozenset("math mfrac mi mn mo mover mrow ms msqrt msub msubsup msup mtext munder munderover semantics svg g path circle rect line polyline polygon ellipse text tspan defs use".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template title textarea iframe".split())
#: Form controls, as RAW, but with tags of their own inside: without an end tag they end with their parent.
HIDDEN = frozenset("select button datalist".split())
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes an open element of these, if no other block stands between.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Block-level starts that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Block(NamedTuple):
    text: str
    around: frozenset[str]  #: tags of its ancestors, and words of their class, id and role
    parent: str
    linked: int  #: characters of the text that are inside links


def leaf_blocks(html: str, intern: Callable[[str], str | None] = lambda name: name) -> list[Block]:
    """Blocks with text, in page order. ``intern`` may map or drop (None) the names that go into ``around``."""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked = links = hidden = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(text, stack[-1][1], stack[-1][0], min(linked, len(text))))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal hidden
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        hidden -= tag in HIDDEN

    while token := _TOKEN.match(html, at):
        at = token.end()
        text = token["text"]
        if text is not None:
            if hidden:
                continue
            pieces.append(text)
            if links:
                linked += len(text)
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if token["end"] else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        links = 0
        if token["end"]:
            if open_tags[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            found = _RAW_END[tag].search(html, at)
            at = found.end() if found else len(html)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P and stack[-1][0] == "p":
            pop()
        while len(stack) > 1 and stack[-1][0] in CLOSES.get(tag, ()):
            pop()
        names = [f"<{tag}>"]
        attrs = token["attrs"]
        if attrs and "=" in attrs:
            names += [f".{word}" for m in _ATTRIBUTE.findall(attrs) for word in _WORDS.findall("".join(m).lower())]
        around = stack[-1][1]
        new = [n for n in map(intern, names) if n is not None and n not in around]
        stack.append((tag, around.union(new) if new else around))
        open_tags[tag] += 1
        hidden += tag in HIDDEN
    flush()
    return blocks
