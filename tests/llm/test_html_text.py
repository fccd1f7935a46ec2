"""Main text of pages: hand-made pages with known articles, broken markup, and the given pages by their own rule."""

from __future__ import annotations

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import html_text
from riskloom.llm.common import table

LONG = [f"Sentence {i} of the article tells, at some length, what happened on day {i} and why it did." for i in range(6)]
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8)) + "</ul>"
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LONG)

PAGES = {
    "plain div": (f'<body><div id="menu">{MENU}</div><div class="content"><h1>Title</h1>{PARAGRAPHS}</div><div class="footer">(c) us</div>', ["Title", *LONG]),
    "no class": (f"<body><div>{MENU}</div><div><h2>Title</h2><div>{PARAGRAPHS}</div></div><div><a href=x>imprint</a></div>", ["Title", *LONG]),
    "article with comments": (
        f'<main><article><header><h1>Title</h1></header>{PARAGRAPHS}<section id="comments"><h3>3 comments</h3><p>{LONG[0]} I agree!</p></section>'
        f'<aside><p>Related: {LONG[1]}</p></aside></article></main><div class="sidebar widget"><p>{LONG[2]}</p></div>',
        ["Title", *LONG],
    ),
    "header of the site": (f"<header><h1>Site name</h1></header><article>{PARAGRAPHS}</article><footer>f</footer>", LONG),
    "notice, form, advert": (
        f'<div class="cookie-notice"><p>{LONG[0]}</p></div><article><h1>T</h1><form><p>Your mail <input></p></form>'
        f'<div class="ad">Buy</div>{PARAGRAPHS}<script>var x = "<p>no</p>";</script><style>p{{}}</style></article>',
        ["T", *LONG],
    ),
    "inline and white space": ("<article><p>One\n <b>two</b>\t<a href=x>three</a>&nbsp;four<br>five</p><p>&lt;six&gt; &amp;amp; &#233;</p></article>", ["One two three four five", "<six> &amp; é"]),
    "unclosed": ("<article><p>One <b>bold<p>Two<ul><li>a<li>b</ul><p>Thr", ["One bold", "Two", "a", "b", "Thr"]),
    "comment with tags": ("<article><p>a<!-- <p>no</p> > -->b</p></article><!-- never closed <p>x", ["ab"]),
    "class that only looks alike": (f'<div class="header-image-free reading shadow uploads">{PARAGRAPHS}</div>', LONG),
    "layout classes": (f'<div class="page has-sidebar no-comments"><article class="post comments-open tag-ad">{PARAGRAPHS}</article><article class="comment"><p>{LONG[1]}</p></article></div>', LONG),
    "no tags": ("just  text &amp; more", ["just text & more"]),
    "only a menu": ("<nav><a>x</a></nav>", []),
    "block inside block": ("<article><div>a<div>b</div>c</div><pre> x\n y </pre></article>", ["a", "b", "c", "x y"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html_text.main_text(page).split("\n") == (want or [""])


def by_rule(page):
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    parts = [re.sub(r"</?\w[^>]*>", lambda m: " " if "br" in m[0] else "", x) for x in parts]
    parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in parts]
    return "\n".join(x for x in parts if x)


def test_given_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = html_text.extract(pages).collect()
    assert len(rows) == len(source) and rows[0].asDict().keys() >= {"page_id", "url", "text", "n_chars"}
    for r in rows:
        assert r.text == by_rule(source[r.page_id]) and r.n_chars == len(r.text)


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (2, None, ""), (3, "u", "<b>" * 50_000 + "deep" + "</i>" * 1000), (4, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0, r.text[:9], r.n_chars) for r in html_text.extract(df).collect()))
    assert got == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0), (3, "deep", 4), (4, "y" * 9, 300_000)]
    assert html_text.extract(df.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div> </div> <li> <b> </b> <a href='x\"> <script> </script> <!-- --> < > & x <br/> <td> <table> </table> <svg/> <title>".split()), max_size=40))
def test_broken_markup_never_fails(parts):
    assert isinstance(html_text.main_text("".join(parts)), str)


WRAPPED = [
    *[f'<div {a}>{MENU}<h1>Title</h1>{PARAGRAPHS}</div>' for a in ('class="hfeed site right-sidebar"', 'class="content widget"', 'id="layout-sidebar-right"')],
    f'<form action="/page.aspx"><div class="menu">{MENU}</div><div><h1>Title</h1>{PARAGRAPHS}</div></form>',
]


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'title="The hidden valley"', 'data-id="ad-1"', 'data-role="navigation"', "title='class=\"ad\"'"])
def test_only_whole_attributes_count(attributes):
    page = f"<body><div {attributes}><h1>Title</h1>{PARAGRAPHS}</div><div hidden><p>{LONG[0]}</p></div><div class=x role=navigation><p>{LONG[1]}</p></div>"
    assert html_text.main_text(page).split("\n") == ["Title", *LONG]
    inner = f"<article><p {attributes}>{LONG[0]}</p></article>"
    assert html_text.main_text(inner) == LONG[0]


@pytest.mark.parametrize("page", WRAPPED)
def test_names_and_forms_around_the_page_do_not_empty_it(page):
    text = html_text.main_text(f"<body>{page}</body>").split("\n")
    assert text[-7:] == ["Title", *LONG]


def test_one_paragraph_or_plain_text_in_a_wrapper():
    assert html_text.main_text(f'<body><div class="content widget"><p>{LONG[0]}</p></div></body>') == LONG[0]
    assert html_text.main_text(f"<body><form>{LONG[0]}</form></body>") == LONG[0]


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "related"])
def test_longer_comments_still_go(name):
    other = f'<div class="{name}">' + "".join(f"<p>{x} And so on, says reader {i}.</p>" for i in range(9) for x in LONG) + "</div>"
    for body in (f"<div><h1>Title</h1>{PARAGRAPHS}</div>", f"<div><h2>Title</h2>{PARAGRAPHS}</div>"):
        assert html_text.main_text(f"<body>{body}{other}</body>").split("\n") == ["Title", *LONG]
        assert html_text.main_text(f'<body><div class="site right-sidebar">{body}{other}</div></body>').split("\n") == ["Title", *LONG]


def test_text_in_several_wrappers_is_kept_in_page_order():
    said = [[f"{LONG[i % 6]} {LONG[(i + row) % 6]} Row {row}, place {i}." for i in range(5)] for row in range(3)]
    rows = "".join('<div class="row"><div class="col">' + "".join(f"<p>{x}</p>" for x in col) + "</div></div>" for col in said)
    page = f'<body><div>{MENU}</div><div class="content">{rows}</div><div><a href="/">imprint</a></div>'
    assert html_text.main_text(page).split("\n") == [x for col in said for x in col]
