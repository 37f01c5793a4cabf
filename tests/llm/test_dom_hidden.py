from marginalia.llm.dom import leaf_blocks


def test_text_after_hidden_elements():
    texts = lambda html: [b.text for b in leaf_blocks(html)]
    assert texts("<p>a</p><svg width='1'/><p>b</p>") == ["a", "b"] and texts("<p>a <math><mi>x</mi><mo>=</mo></math> b</p>") == ["a x= b"] and texts("a<math/>b") == ["ab"]
    for tag in ("button", "select"):
        assert texts(f"<div><p>a<{tag}>no</p><p>b</p></div>c") == ["a", "b", "c"]
        assert texts(f"<div>a<{tag}>no <i>no</i><p>no</p></{tag}>b</div>") == ["a", "b"]
    for tag in ("object", "canvas", "audio", "video", "noscript", "svg"):  # their text is a text's
        assert texts(f"<p>a <{tag}>of <i>it</i></{tag}> b</p>") == ["a of it b"]
    assert texts("a<script>no<p>no") == ["a"] and texts("a<title>no</title>b") == ["a", "b"]
