"""Main text of hand-made pages and of the given ones."""

import html
import re

import pytest
from conftest import DATA

from seriesloom.llm import main_text

CASES = {
 '<html><body><div id="menu"><a href=x>Home</a></div><div class="content"><h1>T</h1><p>Hello <b>bold</b> &amp; <i>it</i>.<p>Second para here</div><div class="sidebar"><p>Side text is here</p></div><div class="comments"><p>Nice article!</p></div></body></html>':"T\n\nHello bold & it.\n\nSecond para here",
 '<main><p>A &lt;x&gt;&nbsp;b</p><form><p>Name</p><input></form><p>tail</p></main><footer>f</footer>':"A <x> b\n\ntail",
 '':'', '<p>':'', 'plain text only':'plain text only', '<div>Cut off &am':'Cut off &am',
 '<article><p>one</p><aside>skip</aside><div class="ad-slot">buy</div><p>two</p><section id="comments"><article class="comment"><p>me too</p></article></section></article>':"one\n\ntwo",
 '<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>x y</p><table><tr><td>a</td><td>b</td></tr></table><ul><li>i1<li>i2</ul><pre>k\n  l</pre></article><div class="cookie-notice">We use cookies</div></body>':"Title\n\nx y\n\na b\n\ni1\n\ni2\n\nk l",
 '<article><p>see <a href=x>all of this linked paragraph</a></p><p><a>only link</a></p><p>end</p></article>':"see all of this linked paragraph\n\nonly link\n\nend",
 '<p>a</p><!-- c <p>no</p> --><script>if (a<b) "<p>x</p>"</script><style>p{}</style><p>b':"a\n\nb",
 '<article><p>area <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds</p></article>':"area a=2 holds",
    "<div><p>Some text before the links</p><p><a href=x>a link</a></p><p>and after</p></div><ul><li><a>x</a></li></ul>": (
        "Some text before the links\n\na link\n\nand after"
    ),
}


@pytest.mark.parametrize("page", CASES)
def test_page(page):
    assert main_text.main_text(page) == CASES[page]


def test_sums_decide_on_a_page_without_marks():
    said = [f"Paragraph {i} says a good deal about its subject, in more than one clause, so that it is long. " * 3 for i in range(8)]
    body = "".join(f"<div>{x}</div>" for x in said[:4]) + "<div>A short line between.</div>" + "".join(f"<div>{x}</div>" for x in said[4:])
    before = "<div>Acme Daily</div><div>All the news, daily</div><div>Posted in News by staff</div><div><h1>A fine title</h1></div>"
    after = "<div>Buy now</div><div>12 Main Street</div><div>Springfield</div><div>Call us today</div><div>&copy; 2024 Acme. All rights reserved.</div>"
    page = f"<html><body><div>{before}</div><div>{body}</div><div>{after}</div></body></html>"
    want = ["A fine title", *(x.strip() for x in said[:4]), "A short line between.", *(x.strip() for x in said[4:])]
    assert main_text.main_text(page) == "\n\n".join(want)
    # short lines far from any text never surge
    assert main_text.main_text(page.replace(before, before.replace("h1", "b") + "<div>Skip</div>" * 9)) == "\n\n".join(want[1:])
    # a page of short lines only is typical for itself
    assert main_text.main_text("<div>one line</div><div>two lines</div><div>three</div>") == "one line\n\ntwo lines\n\nthree"


WRAPPED = "<{0}><main><h1>A title</h1><p>All of the article text.</p></main><div class='sidebar'><p>Side</p></div></{1}>"


@pytest.mark.parametrize("tag", ['div class="content-sidebar-wrap"', 'div class="has-sidebar"', "div class=no-sidebar", 'div class="with-banner"', 'div class="sidebar"', "form id=f"])
def test_a_wrapper_of_the_article_stays(tag):
    assert main_text.main_text(WRAPPED.format(tag, tag.split()[0])) == "A title\n\nAll of the article text."
    article = WRAPPED.replace("main>", "article>").format(tag, tag.split()[0])
    assert main_text.main_text(article) == "A title\n\nAll of the article text."


def test_titles_inside_an_article_stay():
    page = '<article><p>one</p><h2 id="related-work">Related work</h2><p>two</p><section id="search"><p>three</p></section><section id="social-effects"><p>four</p></section></article>'
    assert main_text.main_text(page) == "one\n\nRelated work\n\ntwo\n\nthree\n\nfour"


def test_most_of_the_text_stays_whatever_its_name():
    page = '<div class="widget-body"><p>The long text of this page is in here.</p></div><div class="widget"><p>Small</p></div>'
    assert main_text.main_text(page) == "The long text of this page is in here."


def test_given_pages_give_their_article(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r for r in main_text.extract(rows).collect()}
    assert len(got) == rows.count()
    for r in rows.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer)", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def test_nulls_repeats_long_pages_and_clashing_columns(spark):
    long = "<article>" + "<p>paragraph of some words</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x y", "t"), (2, "u", long, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract(frame).collect()
    assert len(got) == 4 and {r["text"] for r in got if r["page_id"] == 1} == {""}
    assert next(r for r in got if r["page_id"] == 2)["n_chars"] == 20_000 * len("paragraph of some words") + 19_999 * 2
    assert main_text.extract(frame.limit(0)).count() == 0
