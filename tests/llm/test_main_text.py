import html
import re
import time

import pytest

from stratus.llm.common import table
from stratus.llm.main_text import extract, main_text

LONG = "Some sentence, with commas, that is long enough to count as a paragraph of text."


def plain(page):
    """Of pages with one article element without boilerplate inside: its text."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", body)
                                  .replace("<b>", "").replace("</b>", "")).split())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_pages(spark, sf):
    pages = table(spark, f"/root/testdata/{sf}", "pages")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    assert [r.page_id for r in rows if got[r.page_id] != plain(r.html)] == []


CASES = [
    (None, ""), ("", ""), ("   ", ""), ("just text", "just text"),
    ("<p>a &lt; b &amp;amp; &#233;&nbsp;x&am</p>", "a < b &amp; é x&am"),
    (f"<body><nav>menu</nav><div id=content><p>{LONG}<p>fo<b>o</b>bar<br>baz</div></body>",
     f"{LONG} foobar baz"),
    (f"<article><h1>T</h1><p>{LONG}</p><aside>no</aside><div class='ad box'>no</div>"
     f"<form><p>no</p></form><section id=comments><p>{LONG}</p></section></article>", f"T {LONG}"),
    (f"<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>{LONG}</p></main>"
     "<footer>no</footer>", f"T {LONG}"),
    (f"<div class=sidebar><p>{LONG}{LONG}</p></div><div><h2>T</h2><p>{LONG}</p><p>x, y</p></div>",
     f"T {LONG} x, y"),
    (f"<div><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>end</p></div>",
     f"{LONG} end"),
    (f"<div><p>{LONG}</p></div><div><a href=/>{LONG}{LONG}</a></div>", LONG),
    (f"<script>if (a < b) x('</p>')</script><style>p{{}}</style><article><p>{LONG}", LONG),
    (f"<!-- <p>no</p> --><article><p>{LONG}</p><!-- open > <p>yes</p></article>", f"{LONG} yes"),
    ("<article><h1>Only a title</h1></article><footer>no</footer>", "Only a title"),
    (f"<div style='display:none'>{LONG}</div><article><p>ok</p></article>", "ok"),
    (f"<div class=shadow><p>{LONG}</p></div>", LONG),
    (f"<ARTICLE><P>{LONG}</P></ARTICLE><DIV ROLE=Contentinfo>no</DIV>", LONG),
    (f"<form><main><p>{LONG}</p></main></form>", LONG),
    (f"<p title='a > b' class=\"x>y\">{LONG}", LONG),
    (f"<article><table><tr><td>{LONG}<td>b, c</table></article>", f"{LONG} b, c"),
    (f"<div class=cookie-notice><p>{LONG}</p></div><article><p>x</p></article>", "x"),
    ("<", "<"), ("a < b", "a < b"), ("<p", ""), ("</p></div>", ""), ("<!doctype html>x", "x"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert main_text(page) == text


P = f"<p>{LONG}</p>"
#: Parts set aside that end without an end tag of their own.
OPEN_ASIDES = [
    (f"<html><head><title>T</title><body><article>{P}</article></body>", LONG),
    (f"<head><title>T</title><meta charset=x><article>{P}</article>", LONG),
    ("<head><title>T</title>bare text", "bare text"),
    (f"<article><p class=ad>no<p>{LONG}<p class=notice>no<div>b</div><p class=ad>no<h2>T</h2>x"
     "</article>", f"{LONG} b T x"),
    (f"<article><p class=ad>no <button>no</button> no</p>{P}</article>", LONG),
    (f"<article>{P}<ul><li>a<li class=share>no<li>b<li hidden>no</ul>c</article>", f"{LONG} a b c"),
    (f"<article>{P}<dl><dt hidden>no<dd>y<dt>z</dl>c</article>", f"{LONG} y z c"),
    (f"<article>{P}<table><thead hidden><tr><th>no<tbody><tr class=ad><td>no<tr><td>y"
     "<td class=ad><ul><li>no<td>z</table>c</article>", f"{LONG} y z c"),
    (f"<article><div><nav>no</div>{P}</article>", LONG),
    (f"<div><nav><table><tr><td>no</div>no</table>no</nav>{P}</div>", LONG),
    (f"<article><p>{LONG} <b>x <span class=ad>no</b> y <span class=ad>no<p>b</article>",
     f"{LONG} x y b"),
    (f"<article><p>{LONG} <a class=share>no<a href=x>yes</a> b</article>", f"{LONG} yes b"),
    (f"<article><p>{LONG} <span class=ad>no<span>no</span>no</span> b</article>", f"{LONG} b"),
]
#: Wrappers that a class or id word names.
WRAPPERS = [
    (f"<div class='page has-sidebar'><article>{P}</article></div>", LONG),
    (f"<div class='page has-sidebar'><div>{P * 3}</div><div class=sidebar>{P}</div></div>",
     " ".join([LONG] * 3)),
    (f"<div class=sidebar-layout><div>{P * 3}</div></div>", " ".join([LONG] * 3)),
    (f"<main><div class=with-sidebar>{P * 3}</div></main>", " ".join([LONG] * 3)),
    (f"<div class=with-sidebar><article>{P * 3}</article></div><article>{P}</article>",
     " ".join([LONG] * 3)),
    (f"<div class='post share'>{P * 3}</div><div><a href=/>x</a></div>", " ".join([LONG] * 3)),
    (f"<article>{P}<div id=comments>{P * 3}<article>{P}</article></div></article>", LONG),
    (f"<div id=content>{P}</div><div id=comments>{P * 9}<article>{P}</article></div>", LONG),
    (f"<div class=with-sidebar><article>{P}</article><div id=comments><article class=comment>"
     f"{P * 3}</article></div></div>", LONG),
]


FIVE, SHORT = P * 5, "A short part of the article, as it stands there."
TEXT = " ".join([LONG] * 5)
LINKS = "<div><a href=/>one</a> <a href=/>two</a> x</div>"
#: Pages of several parts without an article element.
SECTIONS = [
    (f"<div><section>{FIVE}</section><section><p>{SHORT}</p></section></div>", f"{TEXT} {SHORT}"),
    (f"<div><section><p>Yes.</p></section><section>{FIVE}</section>{LINKS}</div>", f"Yes. {TEXT}"),
    (f"<div><section>{FIVE}</section><blockquote>a, b</blockquote><table><tr><td>c<td>d</table>"
     "<ul><li>e</ul><pre>f</pre><p>g <a href=/>h</a> and more of the text</p></div>",
     f"{TEXT} a, b c d e f g h and more of the text"),
    (f"<div>in front<section>{FIVE}</section>in the end</div>", f"in front {TEXT} in the end"),
    (f"<div><div><h2>A</h2><div>{FIVE}</div></div><div><h2>B</h2><div>{SHORT}</div></div></div>",
     f"A {TEXT} B {SHORT}"),
    (f"<body>{LINKS * 9}<div><div><section>{FIVE}</section></div><div><section>{SHORT}</section>"
     f"</div></div><div class=sidebar>no</div><form>no</form></body>", f"{TEXT} {SHORT}"),
    (f"<table><tr><td>{FIVE}<tr><td>{SHORT}</table>", f"{TEXT} {SHORT}"),
    ("".join(f"<section><h2>{i}</h2><p>{SHORT}</p></section>" for i in range(6)),
     " ".join(f"{i} {SHORT}" for i in range(6))),
]


@pytest.mark.parametrize("page,text", SECTIONS)
def test_siblings_that_read_like_text_stay(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page,text", OPEN_ASIDES)
def test_open_asides_end_where_html_ends_them(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page,text", WRAPPERS)
def test_named_wrappers_are_judged_by_what_they_hold(page, text):
    assert main_text(page) == text


def test_asides_take_linear_time():
    for page in ("<nav>" + "<div>" * 60000 + "</p>" * 60000, "<div class=ad>" * 60000 + "x",
                 "<span class=ad>" * 60000 + "</i>" * 60000, "<p class=ad>x" * 60000,
                 "<li class=ad>x" * 60000, "<div>" * 60000 + "<li hidden></li>" * 20000):
        start = time.process_time()
        main_text(page)
        assert time.process_time() - start < 8


def test_time_is_linear():
    for page in ("<div>" * 60000 + "x", "<p>" * 60000, "<a href='" * 20000, "<!--" * 50000,
                 "<script>" * 20000, "</div>" * 60000, "<b>" * 60000 + "&" * 60000,
                 f"<article><p>{LONG * 5000}</p></article>", "<form>" * 3000 + "x"):
        start = time.process_time()
        main_text(page)
        assert time.process_time() - start < 8


def test_raw_elements_in_capitals_beside_letters_that_grow():
    """Lower case of the first letter has two signs."""
    for sign in "Iİ":
        page = f"<article><SCRIPT>var x = '<p>no</p>';</SCRIPT><p>{sign} {LONG}</p></article>"
        assert main_text(page) == f"{sign} {LONG}"
        assert main_text(f"{sign}<StYle>no</sTYLE ><article><p>{LONG}</p></article>") == LONG


@pytest.mark.parametrize("depth", [3, 505, 520, 3000])
def test_end_tags_close_what_stands_around_any_depth(depth):
    junk = f"<div class=x><a href=/>{LONG}</a></div>"
    assert main_text(f"<article><p>{LONG}</p>{'<div>' * depth}</article>{junk}") == LONG
    assert main_text(f"<ul><li>a{'<div>' * depth}b</ul><article><p>{LONG}</p></article>") == LONG
    page = f"<article><ul><li>x{'<div>' * depth}<li>{LONG}</ul>{P}</article>"
    assert main_text(page) == f"x {LONG} {LONG}"


def test_cited_links_of_an_article_stay():
    links = "<ul><li><a href=1>one source</a></li><li><a href=2>another</a></li></ul>"
    assert main_text(f"<article><p>{LONG}</p>{links}</article>") == f"{LONG} one source another"
    named = links.replace("<ul>", "<ul class='related links'>")
    assert main_text(f"<article>{P * 3}{named}<nav>{links}</nav></article>") == " ".join([LONG] * 3)


QUOTES = [
    (f"<article><p title='x>{LONG}</p></article>", LONG),
    (f'<article><p title="a>b" class=\'c"d\'>{LONG}</p></article>', LONG),
    (f"<article><p don't>{LONG}</p><p \">{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><p a= 'x>y' b='>{LONG}</p></article>", LONG),
]


@pytest.mark.parametrize("page,text", QUOTES)
def test_quotes_in_tags(page, text):
    assert main_text(page) == text


ODD = ["<!-- >", "İ<script></script>", "<svg/>", '<a x=">" y=', "<a b=\"'>", "<a \"'", "<ul><li>",
       "<li><div>", "<table><tr><td>", "<h1><h2>", "<p class=ad><p>", "<!", "<a<", "<a x=' ", "&"]


@pytest.mark.parametrize("piece", ODD)
def test_repeated_odd_markup_takes_linear_time(piece):
    """Twice the page, about twice the time."""
    times = []
    for n in (10000, 20000, 40000):
        start = time.process_time()
        main_text(piece * n)
        times.append(time.process_time() - start)
    assert times[2] < 8 and times[2] < 4 * times[1] + 0.3


@pytest.mark.parametrize("page", [
    "<div>" * 20000 + "</article>" * 20000, "<div>" * 20000 + "</p>" * 20000,
    "<nav>" + "<div><li>" * 20000, "<nav>" + "<div>" * 20000 + "</p>" * 20000,
    "<form>" * 20000 + "<article><p>x</p></article>"])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 5


def test_dotted_and_repeated_column_names(spark):
    df = spark.createDataFrame([(1, f"<p>{LONG}</p>", "x", "y")], "page_id long, html string, `a.b` string, `Text` string")
    got = extract(df)
    assert got.columns == ["page_id", "a.b", "text"]
    assert got.first()[-1] == LONG and got.first()["a.b"] == "x"


def test_tables(spark):
    rows = [(i, "u", p, "own", 1) for i, (p, _) in enumerate(CASES)] + [(0, None, "x", "own", 2)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract(df)
    assert got.columns == ["page_id", "url", "n_chars", "text"]
    assert sorted((r.page_id, r.text) for r in got.collect()) == sorted(
        [(i, t) for i, (_, t) in enumerate(CASES)] + [(0, "x")] * 2)
    assert extract(df.limit(0)).count() == 0
