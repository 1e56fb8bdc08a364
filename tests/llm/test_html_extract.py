import html
import re

import numpy as np
import pytest

from riskloom.llm import html_extract, queries


def text_of(source):
    return html_extract.main_text([source], html_extract.default_model())[0]


def test_every_page_of_the_table(spark, sf):
    """These pages mark their article, so its blocks are the answer."""
    folder = sf.replace("sf0.001", "sf0.01")
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    out = queries.QUERIES["op1_html_extraction"](spark, folder).collect()
    assert len(out) == len(sources)
    for r in out:
        inside = re.search(r"<article>(.*)</article>", sources[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split())
                  for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
<header class="site-header"><h1>Site name</h1><nav><a href=/>Home</a> <a href=/x>More</a></nav></header>
<div id="cookie-banner"><p>We use cookies to make this page better for you. Accept them?</p><button>Yes</button></div>
<main><article>
<h1>The &quot;title&quot; &amp; more</h1><!-- <p>not here</p> -->
<p>First   paragraph with <b>bold</b>,<br>a break and a <a href="/l">link</a>.
<p>Second one; caf&eacute; &#8217;s &#x41;.</p>
<ul><li>one</li><li>two</ul>
<table><tr><td>cell</td><td>other</table>
<div class="advertisement"><p>Buy this now, it is very good for all of you.</p></div>
<script>document.write("<p>no</p>")</script><noscript>no script</noscript>
<p>Last.</p>
<section id="comments"><h3>Comments</h3><p>I think this is a very good page, thank you.</p><p>So do I.</p></section>
</article></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=1>One more page</a></li><li><a href=2>Two</a></li></ul></aside>
<form class="newsletter"><label>Your mail</label><input name=m><button>Subscribe</button></form>
<footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_article_without_its_surroundings():
    assert text_of(PAGE) == "\n".join([
        'The "title" & more', "First paragraph with bold, a break and a link.", "Second one; café ’s A.", "one", "two",
        "cell", "other", "Last."])


def test_labelled_pages_that_were_not_trained_on():
    trees = html_extract.forest([html_extract.parse(p) for p in html_extract.labelled_pages(60, seed=1234)])
    state, _, _ = html_extract.marginals(trees, html_extract.default_model())
    known = trees.label >= 0
    assert ((state[:, 1] > 0.5) == trees.label)[known].mean() > 0.98


def test_marginals_equal_enumeration():
    """Sum-product against summing over all states of a small tree."""
    trees = html_extract.forest([html_extract.parse("<div><p>a</p><ul><li>b</li></ul></div><p>c</p>")])
    random = np.random.default_rng(2)
    model = html_extract.Model(random.normal(size=len(html_extract._FEATURES)), random.normal(size=(4, 2, 2)))
    local = np.bincount(trees.row, weights=model.node[trees.column], minlength=trees.size)
    total, single, pair = 0.0, np.zeros(trees.size), np.zeros((trees.size, 2, 2))
    for code in range(1 << trees.size):
        state = [(code >> at) & 1 for at in range(trees.size)]
        weight = np.exp(sum(local[at] for at in range(trees.size) if state[at]) + sum(
            model.tie[trees.tie[at], state[trees.parent[at]], state[at]]
            for at in range(trees.size) if trees.parent[at] >= 0))
        total += weight
        single += weight * np.array(state)
        for at in range(trees.size):
            if trees.parent[at] >= 0:
                pair[at, state[trees.parent[at]], state[at]] += weight
    got, both, log_total = html_extract.marginals(trees, model)
    assert np.allclose(got[:, 1], single / total) and np.allclose(both, pair / total)
    assert np.isclose(log_total, np.log(total))


@pytest.mark.parametrize("source,wanted", [
    ("", ""), (None, ""), ("<", "<"), ("<p", ""), ("<script>", ""), ("<!-- x", ""), ("</p></div>", ""),
])
def test_broken_pages(source, wanted):
    assert html_extract.main_text([source], html_extract.default_model()) in ([wanted], [""])


def test_edges(frame):
    long = "<article><h1>Long</h1>" + "<p>Some words of a long page.</p>" * 20_000 + "</article>"
    deep = "<div>" * 3_000 + "<p>deep</p>"
    rows = [(1, "u", None, 1), (2, None, PAGE, 2), (2, None, PAGE, 2), (3, "u", long, 3), (4, "u", deep, 4),
            (5, "u", "\x00 <p>&#0; &bogus; &am</p>", 5)]
    df = frame(rows, "page_id long, url string, html string, text int")
    out = html_extract.extract(df).collect()
    assert len(out) == 6 and {r.text for r in out if r.page_id == 1} == {""}
    assert [r.text for r in out if r.page_id == 3][0].count("\n") == 20_000
    assert html_extract.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("part", [
    "<object>", "<svg>", "<div>", "</section>", "<li><div>", "<td>", "<p>", "</ x", "<a '", "<svg x='", "<!--", "<noscript>"])
def test_time_is_in_proportion_to_the_page(part):
    import time

    took = []
    for times in (4_000, 16_000):
        began = time.process_time()
        page = html_extract.parse("<p>some words</p>" + part * times)
        html_extract.forest([page])
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + .3


def test_unclosed_elements_and_signs():
    page = html_extract.parse("<p>first <object data='x'>within <b>it</p><p>second 1 < 2</p><svg>a</svg><p>third")
    assert page.text == ["first", "within it", "second 1 < 2", "third"]
    assert html_extract.parse("<p>text <!-- cut off <p>more</p> and").text == ["text"]
    assert html_extract.parse("<p>text <script>cut off <p>more</p> and").text == ["text"]
    assert html_extract.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e").text == ["a", "b", "c", "d", "e"]
    assert html_extract.parse("").text == [] and html_extract.parse("no tags").text == ["no tags"]
