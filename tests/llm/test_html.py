"""HTML extraction: the region by learned weights, marks by names, malformed markup, and odd tables."""

import html
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from postmill.llm import html_text
from postmill.llm.shared import ship

PAGES = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()


@pytest.fixture(scope="module")
def weights():
    inside, outside = Counter(), Counter()
    for r in PAGES:
        html_text.count_page(r["html"], inside, outside)
    return html_text.weights_from({k: (inside[k], outside[k]) for k in inside | outside})


def neutral(page):
    """The page with its elements and classes renamed to ones that say nothing."""
    for old, new in (("article>", "div>"), ("nav>", "div>"), ("footer>", "div>"), (' class="ad"', ' class="x3"')):
        page = page.replace(old, new)
    return page


def article_of(page):
    """An independent reading of the given pages: the article without tags."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.DOTALL)[1]
    return html.unescape(re.sub(r"<[^>]+>", " ", inner)).split()


def test_region_finds_content_with_the_mark_hidden(weights):
    """The scan does not see article elements: pages give their article with them, without them, and with all names taken away."""
    for r in PAGES:
        want = article_of(r["html"])
        assert html_text.extract(r["html"], weights).split() == want
        assert html_text.extract(r["html"].replace("article>", "div>"), weights).split() == want
        assert html_text.extract(neutral(r["html"]), weights).split() == want


def test_without_the_scan_the_text_is_another(weights, monkeypatch):
    monkeypatch.setattr(html_text, "best_region", lambda scores: (0, len(scores)))
    assert all(html_text.extract(r["html"], weights).split() != article_of(r["html"]) for r in PAGES if re.search(r"<title>\s*\w", r["html"]))


def test_weights_learned_on_other_pages():
    """Learned on half of the pages, measured on the other half."""
    inside, outside = Counter(), Counter()
    for r in PAGES[::2]:
        html_text.count_page(r["html"], inside, outside)
    half = html_text.weights_from({k: (inside[k], outside[k]) for k in inside | outside})
    for r in PAGES[1::2]:
        assert html_text.extract(neutral(r["html"]), half).split() == article_of(r["html"])


def test_words_are_positive_and_tags_negative(weights):
    for kind, w in weights.items():
        name = kind.split("@")[0]
        assert w > 0 if name == "word" and kind != "word@title" else True
        assert w < 0 if name not in ("word", "linkword") else True
    assert weights["word@p"] > 1 and weights["li@link"] < -1 and weights["word@title"] == 0


def test_best_region_equals_all_regions():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice((-3, -1, -0.5, 0, 0.5, 1, 2)) for _ in range(rng.randrange(0, 14))]
        lo, hi = html_text.best_region(s)
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])
        assert abs(sum(s[lo:hi]) - best) < 1e-9


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p title='a hidden gem'>one two three four</p>", "one two three four"),
        ("<p data-role='navigation' data-id=nav data-class='ad'>hello there</p>", "hello there"),
        ("<p>where <math><mi>x</mi></math> is</p>", "where x is"),
        ("<p data-x=don't>first block</p><p>second block's</p>", "first block\nsecond block's"),
        ("<p title='a > b'>one</p><p title=\"don't\">two</p>", "one\ntwo"),
        ('<p title="never closed>one two three</p><p>four five</p>', "one two three\nfour five"),
        ("<article><h2 class='article-header'>Head</h2><p>x y z</p><p class='research notice-board'>text here</p></article>", "Head\nx y z\ntext here"),
        ("<article><p>one two three four</p><ul><li>one<li>two words</ul></article>", "one two three four\none\ntwo words"),
        ("<article><p>abc</p><div class='cookie-notice'>no</div><div class='site-footer'>no</div><div id=comments>c c</div><p>end</p></article>", "abc\nend"),
        ("<article><p>a &amp; b &#233; &#x41;&nbsp;c</p><div hidden>no</div><p style='display: none'>no</p><!-- no --></article>", "a & b é A c"),
        ("<article><p>abc</p><section class='related-posts'>no</section><div class='ArticleComments'>no</div><div role='search'>no</div></article>", "abc"),
        ("<article><p>one two</p><div class='social-history'><p>three</p></div><div id='related-work'><p>four</p></div><div class='ad-hoc-networks'><p>five</p></div><p class='translator-comment'>six</p></article>", "one two\nthree\nfour\nfive\nsix"),
        ("<p>a<!-->b</p><p>after</p><!---><p>end</p>", "ab\nafter\nend"),
        ("<ul><li><a href=x>Home</ul><p>one two three four</p><p>five six</p>", "one two three four\nfive six"),
        ("<html><head><title>Only a title</title></head><body></body></html>", ""),
        ("", ""),
        ("<", "<"),
        ("plain text only", "plain text only"),
        ("<article></article>", ""),
    ],
)
def test_pages(page, want, weights):
    assert html_text.extract(page, weights) == want
    assert html_text.extract(page, html_text.PLAIN) == want


def test_long_and_malformed_pages_end_soon(weights):
    for page in ("<" * 50_000, "<p " * 50_000, "<a b='" * 20_001, "<!--" * 30_000, "<div>" * 50_000 + "x", "</p>" * 50_000, "<svg " * 20_000, "<script>" * 5_000):
        html_text.extract(page, weights)
    words = "word " * 400_000
    assert html_text.extract(f"<article><p>{words}</p></article>", weights) == words.strip()


def test_tables_with_repeats_clashes_and_no_rows(spark):
    ship(spark)
    page = "<html><body><nav><a href=x>menu</a></nav><article><p>one two three</p></article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "7 as text", "8 as kind", "9 as inside")
    got = html_text.extract_text(pages).collect()
    assert sorted((r["page_id"], r["text"], r["kind"], r["inside"]) for r in got) == [(1, "one two three", 8, 9)] * 2 + [(2, "", 8, 9), (3, "", 8, 9)]
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_query_equals_plain_version(spark, weights):
    from postmill.llm import queries

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.op10_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r["page_id"]: (t := html_text.extract(r["html"], weights), len(t)) for r in PAGES}
    for r in PAGES:
        assert got[r["page_id"]][0].split() == article_of(r["html"])
