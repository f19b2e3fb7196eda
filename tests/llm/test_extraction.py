import itertools

import numpy as np
import pytest

from tidemark.llm.extraction import blocks, extract_pages, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><h1>My Site</h1><nav><a href=/>Home</a></nav></header>
<div id="cookie-notice">We use cookies. <button>OK</button></div><main><h1>Title here</h1><p>First paragraph of the article,
 with <a href="x">a link</a> inside.<p>Left open &amp; decoded &lt;b&gt;.<div class="ad">Buy now!</div><form><label>Name</label></form></main>
<aside><h3>Related</h3><ul><li><a>One</a></li></ul></aside><section class="comments"><p>Great post, I liked it a lot and will return.</p></section><footer>&copy; x</footer></body></html>"""


def test_article_without_boilerplate():
    assert main_text(PAGE) == "Title here\nFirst paragraph of the article, with a link inside.\nLeft open & decoded <b>."


def test_page_without_semantic_elements():
    page = '<div class="menu"><a>a</a> <a>b</a></div><div class="content"><h2>Head line</h2><p>Some long paragraph of text that is the article and goes on for a while.</p><p>Short.</p></div><div id="sidebar"><p>Subscribe to our newsletter today for more and more news.</p></div>'
    assert main_text(page) == "Head line\nSome long paragraph of text that is the article and goes on for a while.\nShort."


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- x", "<script>never ends", "</div></p>", "<a" * 500, "<div>" * 3000 + "x", "&amp", "<p>a</b></p>"])
def test_broken_pages_end(page):
    assert isinstance(main_text(page), str)


def test_blocks_know_their_place():
    found = blocks("<article><h1>a</h1><p>b <b>c<br>d<p><a>e</a></article><footer>f</footer>")
    assert [(b.text, b.inside, b.out) for b in found] == [("a", True, False), ("b c d", True, False), ("e", True, False), ("f", False, True)]
    assert found[2].link == 1


@pytest.mark.parametrize("seed", range(40))
def test_minimum_cut_is_minimal(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    costs = rng.integers(-5, 6, n).astype(float).tolist()
    edges = [(int(a), int(b), float(rng.integers(1, 4))) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

    def loss(side):
        return sum(-c if s and c < 0 else c if not s and c > 0 else 0 for c, s in zip(costs, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])

    assert loss(minimum_cut(costs, edges)) == min(map(loss, itertools.product([False, True], repeat=n)))


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "<article><p>" + "w " * 50_000, "x")], "page_id long, url string, html string, text string")
    out = sorted(((r.page_id or 0), r.url, r.n_chars, len(r.text)) for r in extract_pages(df).collect())
    assert out == [(0, None, 0, 0), (1, "u", len(main_text(PAGE)), len(main_text(PAGE))), (1, "u", len(main_text(PAGE)), len(main_text(PAGE))), (2, "v", 99_999, 99_999)]
    assert extract_pages(df.limit(0)).count() == 0
