import random

from marginalia.llm.dom import leaf_blocks


def plain_text(html):
    """The text outside of tags and comments, one character after the other; a quote that is never closed is a plain character."""
    out, i = [], 0
    while i < len(html):
        if html.startswith("<!--", i):
            i += 4
            if html.startswith((">", "->"), i):
                i = html.index(">", i) + 1
                continue
            ends = [k for k in (html.find("-->", i), html.find("--!>", i)) if k >= 0]
            i = html.index(">", min(ends)) + 1 if ends else len(html)
        elif html[i] == "<" and i + 1 < len(html) and html[i + 1].isalpha() or html.startswith("</", i) and html[i + 2 : i + 3].isalpha():
            begin, state = i, "tag"
            i += 2 if html[i + 1] == "/" else 1
            while i < len(html) and html[i] != ">":
                c = html[i]
                if state == "tag":
                    state = "between" if c in " \n/" else "tag"
                elif state in ("between", "named") and c in " \n":
                    pass
                elif state == "between":
                    state = "between" if c == "/" else "name"  # also = as a name's first character
                elif state in ("name", "named") and c == "=":
                    state = "value"
                elif state == "name":
                    state = "named" if c in " \n" else "between" if c == "/" else "name"
                elif state == "named":
                    state = "between" if c == "/" else "name"
                elif state == "value" and c not in " \n":
                    close = html.find(c, i + 1) if c in "'\"" else -1
                    if close >= 0:
                        i, state = close, "between"
                    else:
                        state = "unquoted"
                elif state == "unquoted" and c in " \n":
                    state = "between"
                i += 1
            if i >= len(html):  # a tag that is never closed ends at the next >, whatever its quotes
                close = html.find(">", begin)
                i = close if close >= 0 else len(html)
            i += 1
        elif html[i] == "<" and html[i + 1 : i + 2] in ("!", "?", "/") and i + 1 < len(html):
            close = html.find(">", i)
            i = close + 1 if close >= 0 else len(html)
        else:
            out.append(html[i])
            i += 1
    return "".join(out)


def test_quotes_open_values_only_after_equals():
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    assert texts("<p data-x=a'b>First paragraph.</p><p>Second isn't lost.</p>") == ["First paragraph.", "Second isn't lost."]
    assert texts("See <a href=/it's>Don't stop</a> here.") == ["See Don't stop here."]
    assert texts("<p \"stray>one</p><p a='>' b=\">\">two \"three\"</p>") == ["one", 'two "three"']
    assert texts("<p title=\"never closed>four</p><p>five</p>") == ["four", "five"]
    assert texts("a<!-->b<!--->c<!-- x --!>d<!-- > -- y -->e") == ["abcde"]
    assert texts("a<!-- open <p>b") == ["a"]


def test_random_tags():
    rng = random.Random(8)
    atoms = ["<i", "<b ", "</i", ">", "<!--", "-->", "--!>", "->", "'", '"', "=", " ", "/", "x", "y", "a=b", "c='d'", 'e="f"', "\n", "<", "?", "!", "-"]
    for _ in range(30_000):
        html = "x" + "".join(rng.choices(atoms, k=rng.randint(1, 16))) + "z"
        got = "".join(b.text for b in leaf_blocks(html))
        assert got.replace(" ", "") == "".join(plain_text(html).split()), repr(html)


def test_many_open_quotes():
    assert leaf_blocks("<a href='" * 20_000 + "<p>x") is not None and leaf_blocks("<a b=\"c'" * 20_000) is not None and leaf_blocks("<!--" * 20_000) == []
