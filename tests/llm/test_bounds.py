"""Long contaminated texts, deep pages, ids that repeat on many rows."""

import time

import numpy as np
import pytest

from speclab.llm import decontaminate, html_text, language, toxicity
from test_operators import brute_hits, frame, prose


def test_long_contaminated_texts(spark):
    """Work on a text of benchmark words alone grows with its length, not with the square."""
    items = [(i, prose(60, 300 + i)) for i in range(300)] + [(900, "one two"), (901, prose(5, 300))]
    texts = [" ".join(prose(60, 300 + (i * 7 + s) % 300) for i in range(2000)) for s in range(2)] + [prose(30, 1), None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(frame(spark, texts + texts[:1]), bench).collect()}
    assert len(got) == 5 and got[0]["n_hit"] == got[4]["n_hit"]
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["n_items"]) == (120000, 120000, 301)
    assert got[1]["n_hit"] == 120000 and not got[2]["contaminated"] and got[3]["n_words"] == 0
    short = [" ".join(prose(60, 300 + (i * 7) % 300) for i in range(3)) + " one two three", "x " + prose(5, 300)]
    for r in decontaminate.decontaminate(frame(spark, short), bench).collect():
        n, hit, ids = brute_hits(short[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, hit, ids)


@pytest.fixture
def repeated(spark):
    """Two ids on 3,000 rows of different texts, 40 ids on one row each."""
    rows = [(i % 2, f"{prose(8, i)} number {i}", "en", "s", 0) for i in range(3000)]
    rows += [(10 + i, prose(30, i), "de" if i % 2 else "fr", "s", 0) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_toxicity_sample_holds_one_text_an_id(spark, repeated, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0)] + [(10 + i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.train(repeated, labels, docs_per_class=1000)
    assert [len(x) for x in seen[0]] == [42, 42]
    toxicity.train(repeated.repartition(7), labels, docs_per_class=1000)
    assert seen[0] == seen[1]                            # whichever task holds a row


def test_language_sample_is_bounded_by_rows(spark, repeated, monkeypatch):
    sizes = []
    monkeypatch.setattr(language.ByteNet, "fit", lambda self, x, y: sizes.append(np.bincount(y).tolist()) or self)
    net = language.train(repeated, docs_per_label=300)   # each text is one window
    assert net.labels == ["de", "en", "fr"] and sizes[0][0] == sizes[0][2] == 20 and 200 < sizes[0][1] < 400
    equal = repeated.unionByName(frame(spark, ["the same"] * 2000).selectExpr("7L doc_id", "text", "'xx' lang", "source", "n_chars"))
    assert language.train(equal, docs_per_label=300).labels == ["de", "en", "fr", "xx"] and sizes[1][3] == 1


def test_language_network_by_plain_loops():
    """Convolution, pooling and softmax against loops; training lowers the loss."""
    net = language.ByteNet(["a", "b"])
    x = language.windows_of(b"some bytes of text, \xc3\xa9")
    p = net.probabilities(x)[0]
    pooled = []
    for f in range(net.out.shape[0]):
        width = language.WIDTHS[f // language.FILTERS]
        pooled.append(max(0.0, max(sum(float(net.table[k, x[0, i + k], f]) for k in range(width)) for i in range(language.WINDOW))))
    z = np.array(pooled) @ net.out + net.bias
    assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-5)
    before = -np.log(net.probabilities(x)[0, 1])
    net.fit(x, np.array([1]), epochs=3)
    assert -np.log(net.probabilities(x)[0, 1]) < before


def test_language_of_too_many_labels(spark):
    rows = [(i, prose(20, i), f"l{i % 7 if i < 90 else i}", "s", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    net = language.train(docs, max_labels=5)
    assert net.labels == ["l0", "l1", "l2", "l3", "l4"]  # 13 rows each, the rest 12 or 1
    assert {r["lang_pred"] for r in language.identify(docs, net).collect()} <= set(net.labels)


def test_smoothed_ratios_choose_the_lines():
    """A linked headline is text through its neighbours only; links past an article's text are none of it."""
    body = "".join(f"<p>Paragraph {i} of the article, with a good number of words to count as content.</p>" for i in range(5))
    page = f"<article><h1><a href=/x>A linked headline</a></h1>{body}"
    got = html_text.main_text(page).split("\n\n")
    assert got[0] == "A linked headline" and len(got) == 6
    assert html_text.main_text(page, sigma=0.01).split("\n\n") == got[1:]      # without smoothing it is lost
    more = "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(8))
    got = html_text.main_text(f"{page}<ul>{more}</ul></article>")
    assert "A linked headline" in got and "Paragraph 4" in got and not any(f"story {i}" in got for i in range(2, 8))
    inner = html_text.main_text(page.replace("<p>Paragraph 2", f"<ul>{more}</ul><p>Paragraph 2"))
    assert all(f"story {i}" in inner for i in range(8))                          # between two clusters: joined
    plain = f"<div><div>{body}</div></div><div><p>x</p></div><ul>{more}</ul>"
    assert html_text.main_text(plain).count("Paragraph") == 5 and "story 7" not in html_text.main_text(plain)


def test_deep_pages_take_linear_time():
    for tag in ("<div>", "<b>", "<div>x", "<article>x", "<p><b>", "<li><div>", "<div class=ad>x", "<a>", "<li><a>y"):
        start = time.perf_counter()
        html_text.main_text("<p>text " + tag * 20000)
        assert time.perf_counter() - start < 10, tag                             # over a minute when scanned at each tag


def test_open_links_end_with_their_element():
    page = html_text._Lines()
    page.feed("<ul><li><a href=/>Home<li>x</ul><p>Text after a link left open.")
    page.close()
    assert [x[:2] for x in page.lines] == [("Home", 0), ("x", 1), ("Text after a link left open.", 28)]
