"""Main text of pages: the given pages against their article read off by a plain parser, and layouts of other kinds."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from harrow.llm import html_text as H

SF = "/root/testdata/sf0.01"


def plain_article(page):
    inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_query_against_plain_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = H.op12_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain_article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


LONG = "This sentence is long enough to be taken for a sentence of an article, whatever stands around it on the page, and so it should be."
ARTICLE = f"<h1>A  title &amp; more</h1><p>By me<p>{LONG} With <a href=x>a link</a>.<ul><li>One<li>Two</ul><p>Short.</p><blockquote>Quoted &lt;b&gt;\n text&nbsp;x</blockquote><table><tr><td>a<td>b</table><p>Last<br>one."
WANT = f"A title & more\nBy me\n{LONG} With a link.\nOne\nTwo\nShort.\nQuoted <b> text x\na\nb\nLast one."
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav>"
MENU = f"<div id='main-menu'><a href='/x'>Products</a> {LONG}</div>"
HEAD = f"<header><h1>Site</h1><p>{LONG}</p></header>"
FOOT = f"<footer><p>{LONG}</p></footer>"
FOOT_DIV = f"<div class='site-footer'><p>{LONG}</p><p>{LONG}</p></div>"
SIDE = f"<aside><h2>Popular</h2><p>{LONG}</p></aside>"
SIDE_DIV = f"<div class='sidebar-right'><p>{LONG}</p></div>"
NOTICE = f"<div class='cookie-notice' role='alert'>{LONG} {LONG}</div>"
ADVERT = f"<div class=ad>{LONG}</div>"
FORM = f"<form action='/s'><label>{LONG}</label><input><select><option>One<option>Two</select><textarea>{LONG}</textarea></form>"
SCRIPT = "<script>if (a<b) document.write('<p>No</p>')</script><style>p > a {}</style><!-- <p>No</p> --><noscript>No</noscript>"
COMMENTS = f"<section class='comments'><h2>3 Comments</h2><article class='comment'><p>{LONG} {LONG} {LONG} {LONG}</p></article></section>"
COMMENTS_PLAIN = f"<section><h3>Reader comments (2)</h3><p>{LONG} {LONG} {LONG}</p></section>"


@pytest.mark.parametrize("inner", [f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", f"<div class='entry-content'>{ARTICLE}</div>", f"<div class='post'>{ARTICLE}</div>", f"<section>{ARTICLE}</section>", f"<div><div>{ARTICLE}</div></div>"])
@pytest.mark.parametrize("before", ["", HEAD + NAV, NOTICE + ADVERT + MENU, SIDE + SIDE_DIV + FORM])
@pytest.mark.parametrize("after", ["", FOOT, COMMENTS + FOOT_DIV, COMMENTS_PLAIN + SIDE + SCRIPT, FORM + ADVERT + SIDE_DIV])
def test_layouts(inner, before, after):
    assert H.main_text(f"<!doctype html><html><head><title>t</title>{SCRIPT}</head><body class='has-sidebar'>{before}{inner}{after}</body></html>") == WANT


@pytest.mark.parametrize("name", ["siteFooter", "leftsidebar", "topnavbar", "ad-banner", "bannerAd", "userComments", "post_comments", "cookieconsent", "newsletter-box", "Sponsored", "breadCrumb nav", "skip-link", "related-posts", "x ADS y"])
def test_names_that_bar(name):
    assert H.main_text(f"<body><article><p>One.</p><div class='{name}'><p>{LONG}</p></div><p>Two.</p></article></body>") == "One.\nTwo."


@pytest.mark.parametrize("name", ["no-sidebar", "content-with-sidebar", "has-ads", "adverse", "header", "admin-notes", "commentary", "shared", "formal", "navy"])
def test_names_that_do_not_bar(name):
    assert H.main_text(f"<body><article><div class='{name}'><p>One.</p></div><p>Two.</p></article></body>") == "One.\nTwo."


def test_what_stands_inside_an_article():
    page = f"<body>{NAV}<article><header><h1>Title</h1></header><p>One.</p>{ADVERT}<p>Two.</p>{SCRIPT}{FORM}{SIDE}<p>Three.</p>{COMMENTS}</article><article><p>Other.</p></article></body>"
    assert H.main_text(page) == "Title\nOne.\nTwo.\nThree."


def test_unmarked_articles_in_parts():
    inside = f"<div id='main'><h1>Title</h1><p>{LONG}</p>{ADVERT}{FORM}<p>Short.</p><div class='share'>Share</div><div><p>End.</p></div></div>"
    assert H.main_text(f"<body>{NAV}<div id='wrap'>{SIDE_DIV}{inside}{COMMENTS}<div>Contact</div></div>{FOOT_DIV}</body>") == f"Title\n{LONG}\nShort.\nEnd."
    parts = f"<div><section><h2>One</h2><p>{LONG}</p></section>{ADVERT}<section><h2>Two</h2><p>{LONG}</p></section>{SIDE}</div>"
    assert H.main_text(f"<body>{HEAD}{parts}{FOOT}</body>") == f"One\n{LONG}\nTwo\n{LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>One", "One"), ("a < b and c > d", "a < b and c > d"), ("<!-- never closed", ""), ("<nav>a</nav>", ""), ("<div", ""),
        ("<p class='x>y'>Text <b>bo</b>ld<!-- > -->ly</p>", "Text boldly"), ("<article><p>&eacute;&#x41;&#66;&copy &unknown;</article>", "éAB© &unknown;"), ("<article></article>", ""),
        ("<article><p>x<script>never closed", "x"), ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<article><p hidden>no</p><p>yes</p></article>", "yes"),
    ],
)
def test_odd_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x" * 100, '<a href="' * 100_000, "<p>x</p>" * 100_000, "<li>x" * 100_000, "<" * 300_000, "&amp;" * 200_000, '<p class="a' * 50_000 + ">", "<article>" + "<b>x" * 100_000, "</div>" * 100_000, "<script>" * 50_000])
def test_long_pages_take_time_in_proportion(page):
    began = time.time()
    H.main_text(page)
    assert time.time() - began < 20


def test_other_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None)], "page_id long, html string").withColumns({"text": F.lit("mine"), "Line": F.lit("mine"), "n_chars": F.lit(1)})
    got = H.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["Line"], r["n_chars"]) for r in got) == [(0, "", "mine", 1), (1, "a", "mine", 1), (1, "a", "mine", 1)]
    assert H.extract(df.limit(0)).count() == 0
