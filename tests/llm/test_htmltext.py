import itertools
import random
import re
from html import unescape

from marginalia.llm import htmltext
from marginalia.llm.dom import leaf_blocks
from marginalia.llm.htmltext import extract_text, labelled_pages, main_text, page_features, trained


def test_held_out_pages():
    model, right, total = trained(), 0, 0
    for html in labelled_pages(150, seed=1234):
        blocks = leaf_blocks(html)
        truth = [htmltext._MARK in b.text for b in blocks]
        plain = [b._replace(text=b.text.replace(htmltext._MARK, "") or ".") for b in blocks]
        right += sum(a == b for a, b in zip(truth, model.label(plain)))
        total += len(truth)
    assert right / total > 0.98


def test_corpus_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages).collect():
        inside = re.search("<article>(.*)</article>", html[r.page_id], re.S)[1]
        lines = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", inside.replace("<br>", " "))]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_blocks():
    html = "<body><div class='a b'>one <b>two</b><p>x &amp;amp; y&nbsp;z<p title='q>r'>t<script>var p = '<p>';</script>u</div><!-- c <p> -->a < b<ul><li>l1<li>l2</ul><p>open <a href=x>li"
    assert [b.text for b in leaf_blocks(html)] == ["one two", "x &amp; y z", "t", "u", "a < b", "l1", "l2", "open li"]
    assert leaf_blocks(html)[0].around == {"<body>", "<div>", ".a", ".b"}
    assert len(leaf_blocks("<div>" * 20_000 + "deep")) == 1 and leaf_blocks("<a href='x" * 2000) is not None


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<html><body></body></html>"), (None, "u", "<article><h1>Ti tle</h1>" + "<p>Some words of a text, and more of it.</p>" * 3000 + "</article>")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "text")
    out = extract_text(pages).collect()
    assert len(out) == 8 and {r.text for r in out if r.page_id} == {""}
    assert {r.text.count("\n") for r in out if r.page_id is None} == {3000}
    assert extract_text(pages.limit(0)).count() == 0 and main_text(None, trained()) == ""


def test_decoding_is_the_best_labelling():
    """Viterbi against all labellings of short chains, scored from the weights."""
    model, rng = trained(), random.Random(4)
    for html in labelled_pages(25, seed=77):
        blocks = leaf_blocks(html)
        for _ in range(3):
            at = rng.randrange(len(blocks))
            own = blocks[at : at + 9]
            rows = [[model.names[f] for f in features if f in model.names] for features in page_features(own)]

            def score(labels):
                total = model.first[labels[0]] + sum(model.weights[f, y] for y, row in zip(labels, rows) for f in row)
                return total + sum(model.step[a, b] for a, b in zip(labels, labels[1:]))

            best = max(itertools.product((0, 1), repeat=len(own)), key=score)
            assert abs(score(tuple(map(int, model.label(own)))) - score(best)) < 1e-6


def test_late_characters_count():
    block = leaf_blocks("<p>" + "words " * 60 + "1234567890 " * 60 + "</p>")
    assert "digits=True" in page_features(block)[0] and "digits=False" in page_features(leaf_blocks("<p>" + "words " * 600 + "123</p>"))[0]


def test_clashing_names(spark):
    names = ["html", "text", "n_chars", "__html", "c0", "a.b"]
    row = spark.createDataFrame([("<article><p>Some words of it.</p></article>", 1, 2, 3, 4, 5)], names)
    got = extract_text(row)
    assert got.columns == ["__html", "c0", "a.b", "text", "n_chars"] and tuple(got.first())[:3] == (3, 4, 5)
