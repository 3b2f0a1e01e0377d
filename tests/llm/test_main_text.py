"""Main text of pages: classes against occurrence vectors counted page by
page, templates of plain markup, odd pages."""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ranksmith.llm import main_text
from ranksmith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def site(n: int, host: str = "a.example", start: int = 0) -> list[tuple]:
    """Pages without telling markup: only their host-mates show the frame."""
    return [(start + i, f"http://{host}/{i}",
             f"<html><body><div><a>Home</a><a>About us</a></div><div><h2>Title {i}</h2><p>First words {i} of {host}.</p>"
             + "".join(f"<p>More {i} {j}</p>" for j in range(i % 3)) + "</div><div>All rights kept</div></body></html>") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df) -> dict:
    return {r.page_id: r.text for r in main_text.main_texts(df).collect()}


def test_template_of_plain_markup(spark):
    got = texts(frame(spark, site(7) + site(2, "b.example", 100)))
    assert got[4] == "Title 4\nFirst words 4 of a.example.\nMore 4 0"
    # Two pages are no evidence of a template.
    assert got[100] == "Home About us\nTitle 0\nFirst words 0 of b.example.\nAll rights kept".replace("Home About us", "HomeAbout us")


def test_equal_pages_are_one_page(spark):
    rows = [(i, "http://c.example/x", site(1)[0][2]) for i in range(9)]
    assert set(texts(frame(spark, rows)).values()) == {"HomeAbout us\nTitle 0\nFirst words 0 of a.example.\nAll rights kept"}


def test_classes_by_occurrence_vectors(spark):
    rows = site(9)
    pages = [main_text.Page(r[2], tokens=True).tokens for r in rows]
    vectors = defaultdict(lambda: [0] * len(pages))
    for i, tokens in enumerate(pages):
        for t, n in Counter(tokens).items():
            vectors[t][i] = n
    groups = defaultdict(set)
    for t, v in vectors.items():
        n = sum(map(bool, v))
        if n >= main_text.MIN_PAGES and 2 * n >= len(pages):
            groups[tuple(v)].add(t)
    want = {frozenset(g) for g in groups.values() if len(g) >= main_text.MIN_TOKENS}
    given = main_text._given(frame(spark, rows), "page_id", "url", "html")
    got = defaultdict(dict)
    for r in main_text.classes(main_text.token_pages(given)).collect():
        got[r["class"]][r.place] = r.token
    assert {frozenset(g.values()) for g in got.values()} == want
    for own in got.values():  # places follow the page
        first = [pages[0].index(own[k]) for k in sorted(own)]
        assert first == sorted(first)


def test_crossing_and_disordered_classes():
    known = {1: (10, 0, 2, 9), 2: (10, 1, 2, 9), 3: (20, 0, 2, 5), 4: (20, 1, 2, 5)}
    import numpy as np
    of = lambda *t: main_text.crossing(np.array(t), known)
    assert of(1, 3, 4, 2) == set() and of(1, 2, 3, 4) == set() and of(1, 2, 1, 2) == set()
    assert of(1, 3, 2, 4) == {20}
    assert of(3, 1, 4, 2) == {20}
    assert of(2, 1) == {10} and of(1, 3, 2) == {20}


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("no markup & more", "no markup & more"), ("<p>a &lt;b&gt;&nbsp; c&amp;d &#8364;</p>", "a <b> c&d €"),
    ("<nav>x<p>y</nav><p>z", "z"), ("<article><header><h1>T</h1></header><p>x<footer>f</footer></article><p>out", "T\nx"),
    ("<main>in<form>f</form></main>out", "in"), ("<p>a<script>var x='</p>'; if (a<b) 1</script>b", "ab"),
    ("<script>never closed <p>x", ""), ("<p>a<!-- no <p>b</p> -->c", "ac"), ("<p>a<!-- open", "a"), ("<p>a <b class='x", "a"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ('<div class="has-sidebar"><p>x</p></div><div class="sidebar">s</div>', "x"), ('<div id="cookie-notice">c</div><p hidden>h</p><p>x', "x"),
    ('<div class="ad-slot">a</div><div class="shadow">b</div>', "b"), ('<section id="comments"><article>c</article></section><article>t</article>', "t"),
    ('<p title="a > b">x</p><a href="y>z</a><p>w', "x\nz\nw"), ("</div></p><p>x</span></div>y", "x\ny"),
    ("<p>a\n b\t c<br>d</p>", "a b c d"), ("<article>  </article><p>x", "x"), ("<P>A</P><ARTICLE>b</ARTICLE>", "b"),
])
def test_markup(html, want):
    assert main_text.Page(html or "").text() == want


def test_long_and_hostile_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert main_text.Page(deep).text() == "x"
    assert main_text.Page("</i>" * 50_000 + "<p>y" + "<a href=\"" * 20_000).text().startswith("y")
    assert len(main_text.Page("<p>" + "word " * 400_000).text()) == 5 * 400_000 - 1


def test_odd_rows(spark):
    rows = site(5) + [(None, None, None), (7, "not a url", "<p>x"), (8, "http://a.example/0", ""), (9, None, "<p>y"), (9, None, "<p>y")]
    df = frame(spark, rows).withColumn("text", F.lit("clash")).withColumn("known", F.lit(1)).withColumn("host", F.lit(2))
    out = main_text.main_texts(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    assert len(got) == len(rows) and (None, "", 0) in got and (7, "x", 1) in got and got.count((9, "y", 1)) == 2
    assert main_text.main_texts(frame(spark, [])).count() == 0


def test_query_against_marked_articles(spark):
    """In the given pages the article stands between its tags."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op11_main_text"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html_lib.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
