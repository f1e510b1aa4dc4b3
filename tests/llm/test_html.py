"""Operator 13: the reader, messages against enumeration, held-out layouts, edge cases."""

import html
import itertools
import re

import numpy as np
import pytest

from textbench.llm import html_extract as X
from textbench.llm.html_layouts import TEXTS, layout
from textbench.llm.html_tree import Page


def blocks(text):
    page = Page(text)
    return [(page.tag[o], t) for o, t in zip(page.owner, page.text)]


@pytest.mark.parametrize("source,expected", [
    ("a &amp;lt; b<p>x<p>y<b>z</div>t", [("html", "a &lt; b"), ("p", "x"), ("p", "yzt")]),
    ("<ul><li>1<li>2<ul><li>3</ul></ul>", [("li", "1"), ("li", "2"), ("li", "3")]),
    ("<table><tr><td>c<td>d<tr><th>e</table>f", [("td", "c"), ("td", "d"), ("th", "e"), ("html", "f")]),
    ("x<br>y&nbsp; z&eacute;&#233", [("html", "x y zéé")]),
    ("<script>var a = '<p>no</p>';</script><STYLE>p{}</STYLE >yes<title>t</title>", [("html", "yes")]),
    ("one<!-- two <p> --> three<!-->four", [("html", "one threefour")]),
    ("<p title='a>b' data-x=\"c>d\">q</p>", [("p", "q")]),
    ("a<b", [("html", "a<b")]), ("1 < 2 <3", [("html", "1 < 2 <3")]), ("<p", [("html", "<p")]), ("", []),
    ("<b><p>one</b>two</p>three", [("p", "onetwo"), ("html", "three")]),
    ("<div><p>a<div>b</p>c</div>d", [("p", "a"), ("div", "b"), ("div", "c"), ("div", "d")]),
    ("<textarea>no<p></textarea><select><option>no</select><button>no</button>ok", [("html", "ok")]),
    ("<p>a<script>", [("p", "a")]), ("<p>a<!-- no end", [("p", "a")]),
    ("<dl><dt>a<dd>b<dt>c</dl>", [("dt", "a"), ("dd", "b"), ("dt", "c")]),
])
def test_reader(source, expected):
    assert blocks(source) == expected


def test_names_and_links():
    page = Page("<div class='a b' id=c role=\"main\"><div style='display: none'>x</div><p hidden>y<p>u <a href=q>v w</a></div>")
    assert page.names == ["", "a b c main", "hidden", "hidden", ""]
    assert page.linked == [0, 0, 3]


def test_reader_is_linear():
    for text in ("<div>" * 100_000 + "x", "<b>" * 50_000 + "<p>" * 50_000, "<" * 200_000, "<a \"" * 100_000,
                 "<table><td>" + "<span>" * 50_000 + "</div>" * 50_000, "<p a='" * 50_000):
        Page(text)
    assert blocks("<div>" * 2000 + "deep" + "</div>" * 2000 + "after")[0][1] == "deep"


def test_messages_against_enumeration():
    r = np.random.default_rng(1)
    pages = [X.Nodes(Page(t)) for t in ("<div><p>a b</p><ul><li>c</ul></div>d", "<p>x</p>", "", "<nav><a>q</a></nav><p>z")]
    number = {x: i for i, x in enumerate(sorted({x for p in pages for f in p.features for x in f}))}
    unary, pair = r.normal(size=(len(number), 3)), r.normal(size=(len(X.KINDS), 3, 3))
    found = X.Model(number, unary, pair).marginals(pages)
    for page, got in zip(pages, found):
        total, sums = 0.0, np.zeros(page.blocks)
        n = len(page.parent)
        for states in itertools.product(range(3), repeat=n):
            if any(states[i] == X.SOME for i in range(n) if page.kind[i] == 0):
                continue
            score = sum(unary[number[x], s] for i, s in enumerate(states) for x in page.features[i])
            score += sum(pair[page.kind[i], states[page.parent[i]], states[i]] for i in range(n) if page.parent[i] >= 0)
            total += np.exp(score)
            for k in range(page.blocks):
                sums[k] += np.exp(score) * (states[page.elements + k] == X.ALL)
        assert np.allclose(got, sums / total)


@pytest.fixture(scope="module")
def model(spark):
    return X.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_layouts_that_were_not_trained_on(model):
    caught = wrong = total = 0
    for number in range(50_000, 50_300):
        nodes, main = X.layout_page(number, list(TEXTS))
        got = model.marginals([nodes])[0] > .5
        main = np.array(main)
        caught, wrong, total = caught + (got & main).sum(), wrong + (got & ~main).sum(), total + main.sum()
    assert caught / total > .93 and wrong / (wrong + caught) < .07


def test_pages_of_other_forms(model):
    body = "<h1>Storm hits the coast</h1><p>The storm came in on Monday and closed the roads, and many trees fell.</p>" \
           "<p>Nobody was hurt.</p>"
    want = "Storm hits the coast\nThe storm came in on Monday and closed the roads, and many trees fell.\nNobody was hurt."
    menu = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>"
    comment = "<p>I read all of this twice and I think that the paper is right about the storm.</p>"
    for page in (
        body, f"<nav>{menu}</nav><article>{body}</article><footer>&copy; 2020 The Paper</footer>",
        f"<div id=menu>{menu}</div><div class=post-content>{body}</div><div id=footer>&copy; 2020 The Paper</div>",
        f"<header><p>The Paper</p></header><main>{body}<aside><p>Read also the weather page.</p></aside>"
        f"<section class=comments><h2>Comments</h2>{comment}</section></main>",
        f"<div class='cookie-banner'><p>We use cookies on this site. Do you accept?</p></div><article>{body}"
        f"<div class=ad>Buy new shoes today</div></article><form><p>Subscribe to the letter</p></form>",
        f"<div id=content>{body}</div><div id=sidebar><h3>Popular</h3>{menu}</div><ol class=commentlist><li>{comment}</ol>",
    ):
        assert X.main_texts([page], model) == [want], page


def test_query_against_the_authors_mark(spark):
    rows = X.op13_html_extract(spark, "/root/testdata/sf0.01").collect()
    source = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", source[r["page_id"]]["html"], re.S)[1]
        parts = re.split(r"</?(?:h1|p)>|<br>(?=<p>)", article)
        text = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
        assert r["text"] == "\n".join(t for t in text if t)
        assert r["n_chars"] == len(r["text"]) and r["url"] == source[r["page_id"]]["url"]


def test_odd_pages_empty_tables_and_clashing_columns(spark, model):
    schema = "page_id long, url string, html string, text string, c0 int, key long"
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "u", None, "t", 1, 2), (None, None, "", "t", 1, 2), (2, "u", "<article><p>x y</p></article>", "t", 1, 2),
            (2, "u", "<article><p>x y</p></article>", "t", 1, 2), (3, "u", long, None, None, None),
            (4, "u", "<div>" * 3000 + "<p>deep text stands here</p>", "t", 1, 2)]
    d = spark.createDataFrame(rows, schema)
    got = X.extract(d).collect()
    text = [r["text"] for r in got]
    assert text[:4] == ["", "", "x y", "x y"] and len(text[4]) == 999_999 and len(got) == 6
    assert got[0].__fields__ == ["page_id", "url", "text"]
    assert X.extract(d.limit(0), model).count() == 0
    assert [r["text"] for r in X.extract(d.where("page_id = 1"), model).collect()] == [""]
    assert layout(5, list(TEXTS)) == layout(5, list(TEXTS))
    again = X.extract(d.repartition(5), model).collect()
    assert len(again) == 6
