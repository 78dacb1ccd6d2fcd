"""Main text of pages in several layouts, of odd pages, and the scan against every region."""

import html
import re

import pytest

from flowlark.llm import main_text as m

DIR = "/root/testdata/sf0.001"
A = "A first paragraph with enough words to be read as text by anybody."
B = "A second one that follows it, also of some length &amp; with an end."
BODY = [A, html.unescape(B)]
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of today</a></ul></nav>'
FOOT = "<footer><p>&copy; 2024 The site. All rights reserved, as ever, by the owners.</p></footer>"
COMMENTS = f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{A}</p></article><article class="comment"><p>{B}</p></article></section>'


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title></head><body>{NAV}<article><p>{A}</p><p>{B}</p></article>{FOOT}</body></html>",
    f"<body>{NAV}<main><p>{A}<p>{B}</main><aside><p>{A}</p></aside>{FOOT}",
    f'<body class="has-sidebar"><div class="site-header"><p>The site of sites</p></div><div id="content"><div class="entry"><p>{A}</p><p>{B}</p></div></div><div class="sidebar"><p>{A}</p></div>{FOOT}',
    f'<article><p>{A}</p><div class="ad-slot"><p>{A}{A}</p></div><form><label>Mail</label><input><button>Send</button></form><p>{B}</p></article>{COMMENTS}{FOOT}',
    f'<div class="cookie-notice"><p>{A}</p><button>OK</button></div><div><p>{A}</p><p>{B}</p></div><div class="newsletter-signup"><p>{A}</p></div>{COMMENTS}',
    f'<article><p>{A}</p><!-- <p>{A}</p> --><script>var t = "<p>{A}</p>";</script><style>p > b {{}}</style><p hidden>{A}</p><div style="display: none">{A}</div><p>{B}</p></article>',
    f'<article>\n<p title="a > b" class=x>{A}</p>\n\n<p>A second <b>one</b> that\tfollows&nbsp;it,<br>also of some <a href=x>length</a> &#38; with an <i>e</i>nd.</p></article>',
    f"<ARTICLE><P>{A}<P>{B}</ARTICLE><FOOTER>{A}",
])
def test_layouts(page):
    for counts in ({}, {(w, n): (i, o) for w, n, i, o in m.learn([f"{NAV}<article><p>{A}</p><p>{B}</p></article>{FOOT}"] * 90)}):
        assert m.extract(page, m.Weights(counts)).split("\n") == BODY


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p>", "<article></article>", f"{NAV}{FOOT}", "<!-- never closed <p>a", "<script>a", "</p></div>", "\x00", "&", NAV * 2000])
def test_pages_without_text(page):
    assert m.extract(page, m.Weights({})) in ("", "&", "<", "\x00")


def test_broken_markup_loses_no_text():
    """A quote that never ends ends with its tag; an element that nobody opened is nothing."""
    assert m.extract(f'<article><p class="x>{A}</p></b></div><p>1 < 2 <3</article>', m.Weights({})).split("\n") == [A, "1 < 2 <3"]


def test_references_and_space():
    page = "<article><h1>&lt;b&gt; &eacute;&#x1F600; &am &amp</h1><p>one\r\n two\xa0three&#10;four</p><pre>a\n b</pre></article>"
    assert m.extract(page, m.Weights({})) == "<b> é\U0001f600 &am &\none two three four\na b"


def test_region_is_the_best_of_all():
    page = m.Page(f"<div>one two</div>{NAV}<div><p>{A}</p><hr><hr><div><a>x y</a></div><p>{B}</p></div><ul>{'<li><a>z</a>' * 40}</ul><p>end</p>" * 3)
    w = m.Weights({})

    def score(a, b):
        gains = [sum(w.word(c) * n for c, n in page.contexts[i].items()) for i in range(a, b)]
        gains = [g if page.kinds[i] is None else min(g, 0.01) for i, g in enumerate(gains, a)]
        return sum(gains) - sum(w.tag(t) for i in range(a + 1, b) for t in page.between[i])

    best = max(score(a, b) for a in range(len(page.texts)) for b in range(a + 1, len(page.texts) + 1))
    assert abs(score(*m.best_region(page, w)) - best) < 1e-9


def test_weights_come_from_labelled_pages(spark):
    """A class that nobody knows is told by where the text beside it stands."""
    w = m.Weights({(k, n): (i, o) for k, n, i, o in m.learn(["<h4>Odd one out</h4><article><p>Text of it</p></article>"] * 50)})
    assert w.word(("h4", False, None, False)) < 0.05 and w.word(("p", False, None, True)) > 1
    pages = spark.createDataFrame([(i, f"<h6>a b</h6><article><p>c</p></article>{'x' * (i % 2) * 50}") for i in range(20)] + [(None, "<article>")], "page_id long, html string")
    assert m.fit(pages, 5)._counts[("word", "h6 outside")] == (0, 10) and m.fit(pages, 50, 40)._counts[("word", "p")] == (10, 0)
    assert m.fit(pages.limit(0))._counts == {}


def test_given_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (7, "u", ""), (8, None, f"<article>{A * 30000}</article>"), (8, None, f"<article>{A * 30000}</article>")], "page_id long, url string, html string")
    source = pages.unionByName(odd).selectExpr("page_id", "html", "url", "1 as text", "2 as n_chars", "3 as found")
    rows = m.main_text(source).collect()

    def plain(page):
        article = re.search(r"<article>(.*?)</article>", page or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article[1])] if article else []
        return "\n".join(b for b in blocks if b)

    want = [(r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in source.collect()]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert m.main_text(pages.limit(0)).collect() == []
