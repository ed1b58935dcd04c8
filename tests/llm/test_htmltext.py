import itertools
import random
import re

import numpy as np
import pytest

from veilspark.llm import htmltext as h


def test_messages_against_all_labellings():
    rng = np.random.default_rng(3)
    pages = [h.Page("<body><div class=a><p>x</p><p>y <b>z</b></p></div><ul><li>q</ul></body>"), h.Page("<p>one")]
    index = {f: k for k, f in enumerate(sorted({f for p in pages for fs in h.node_features(p) for f in fs}))}
    weights, edges = rng.normal(size=len(index)), rng.normal(size=(3, 2, 2))
    forest = h.Forest(pages, index)
    z, node, joint = forest.marginals(weights, edges)
    score = np.bincount(forest.rows, weights[forest.columns], forest.n)
    total, by_node = 0.0, np.zeros(forest.n)
    for y in itertools.product((0, 1), repeat=forest.n):
        s = sum(score[k] * y[k] for k in range(forest.n)) + sum(edges[forest.kind[k], y[p], y[k]] for k, p in enumerate(forest.parent.tolist()) if k not in forest.first)
        total += np.exp(s)
        by_node += np.exp(s) * np.array(y)
    assert z == pytest.approx(np.log(total)) and node[:, 1] == pytest.approx(by_node / total)
    assert joint[1].sum() == pytest.approx(1)


def test_held_out_accuracy():
    rng, right, total = random.Random(77), 0, 0
    for _ in range(150):
        p, y = h.Page(h.labelled_page(rng)), []
        for k in range(len(p.tags)):
            m = re.search(r"\by=([01])", p.attrs[k])
            y.append(int(m[1]) if m else None)
            p.attrs[k] = re.sub(r"\s*\by=[01]\s*", " ", p.attrs[k]).strip()
        keep, _ = h.train().keep([p])
        right += sum(bool(a) == bool(b) for a, b in zip(keep, y) if b is not None)
        total += sum(b is not None for b in y)
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-header"><a href=/>No</a></header><nav><ul><li><a href=#>No</a><li><a href=#>No</a></ul></nav><!-- no <p>no</p> --><div class="ad">No, buy this.</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;&#233;  line.<br>Second
line<p>Para <a href="x>y">with link</a>, and some more words to read here.<p>1 &lt; 2 &copy; end.</article>
<aside class="sidebar"><p>No</p></aside><section id="comments"><h3>No</h3><div class="comment"><p>No, said a reader.</p></div></section><form><label>No</label><input></form><footer>&copy; no</footer></body></html>"""


def test_pages(spark):
    want = "Title & more\n\nFirst é line. Second line\n\nPara with link, and some more words to read here.\n\n1 < 2 © end."
    long = "<article>" + "<p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "", ""), (1, "u", PAGE), (None, "n", "<div"), (4, "l", long), (5, "q", "<article><p>a <b attr=\"x>y</p><p>end of a page</p></article>")]
    got = {(r.page_id, r.url): r for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")).collect()}
    assert len(got) == len(rows) - 1
    assert got[1, "u"].text == want and got[1, "u"].n_chars == len(want)
    assert got[2, None].text == got[3, ""].text == "" and got[4, "l"].n_chars == 999_999


def test_empty(spark):
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_attribute(quote):
    value = "<p>no</p>" * 10_000
    p = h.Page(f"<article><div data-state={quote}{value}{quote}><p>yes</p></div></article>")
    assert p.tags == ["#root", "article", "div", "p"] and value in p.attrs[2]
    assert [t for _, t in filter(None, p.pieces)] == ["yes"]


def test_tags_without_an_end_are_read_once():
    # the lone quote makes every tag's search for its end fail
    p = h.Page('<b x=">" ' * 40_000 + "'")
    assert len(p.tags) > 40_000
