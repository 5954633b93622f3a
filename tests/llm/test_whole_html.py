"""Pages whose head or drawings have no end tag, and articles in or under layout names."""

import time

import pytest

from gridloom.llm import html_text

LONG = html_text._LONG
FORMS = [
    f"<html><head><title>No</title><meta charset=x><body><article><h1>T</h1><p>{LONG}</p></article>",
    f"<head><title>No</title><script>var a='<p>no</p>'</script><article><h1>T</h1><p>{LONG}</p></article>",
    f"<article><svg width='1' /><h1>T</h1><p>{LONG}</p></article>",
    f"<article><svg><h1>T</h1><p>{LONG}</p></article>",
    f"<div class='page has-sidebar'><article><h1>T</h1><p>{LONG}</p></article></div>",
    f"<div class='no-sidebar'><div id='content'><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div></div>",
    f"<div class='sidebar'><main><h1>T</h1><p>{LONG}</p></main></div>",
    f"<article><header class='entry-header'><h1>T</h1></header><p>{LONG}</p></article>",
]


@pytest.mark.parametrize("page", FORMS)
def test_article_is_whole(page):
    got = html_text.main_texts([page], html_text.fitted())[0]
    assert got.startswith("T ") and LONG in got and "no" not in got.split()[:1] and "var" not in got


def test_comments_stay_out():
    page = f"<article><p>{LONG}</p></article><section class='comments'><article><p>Nice words of a reader here, thanks.</p></article></section><head>"
    assert html_text.main_texts([page], html_text.fitted())[0] == LONG
    assert html_text.blocks("<svg>" * 50_000) == []


TREE_CASES = {
    "a short last line": (f"<article><h1>T</h1><p>{LONG}</p><p>Yes.</p></article>", f"T {LONG} Yes."),
    "a page that is one paragraph": (f"<p>{LONG}</p>", LONG),
    "formulas are text": (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be. {LONG}</p></article><footer>x</footer>", f"Let x=1 be. {LONG}"),
    "what stands in for objects": (f"<article><object data=x><p>Fallback {LONG}</p></object></article>", f"Fallback {LONG}"),
    "a quote in an unquoted value": (f"<article><p class=it's>One {LONG}</p><p>Two {LONG}</p></article>", f"One {LONG} Two {LONG}"),
    "names with a bad word among others": (f"<article><div class='social-history'><p>{LONG}</p></div></article>", LONG),
    "an article's own header": (f"<article><header class='article-header'><h1>Title</h1></header><p>{LONG}</p></article>", f"Title {LONG}"),
    "a title that is a link": (f"<article><h1><a href='/x'>Title of it</a></h1><p>Short.</p><p>{LONG}</p></article>", f"Title of it Short. {LONG}"),
    "one link is a menu": ("<div><a>Home</a></div>", ""),
    "no names at all": (f"<p><a>Top stories</a></p><p>Menu</p><p><a>More of them</a></p><div><h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><p><a>Back</a></p><p>Site</p><p><a>to the top</a></p>", f"Title {LONG} Short one. {LONG}"),
    "humps in names": (f"<div class='cookieNotice'>{LONG}</div><div id=main-content><h1>T t</h1><p>{LONG}</p></div><div class=commentList><p>{LONG}</p></div>", f"T t {LONG}"),
}


@pytest.mark.parametrize("name", TREE_CASES)
def test_tree(name):
    page, want = TREE_CASES[name]
    assert html_text.main_texts([page], html_text.fitted())[0] == want


def test_neighbours_and_density_decide():
    used = html_text.splits(html_text.fitted())
    assert used["link_density"] and used["words"]
    assert used["prev_words"] and used["next_words"] and used["prev_density"] + used["next_density"]


def test_the_same_line_by_its_neighbours():
    """A short line without names is the article's between paragraphs, and a menu's between links."""
    tree, link = html_text.fitted(), "<p><a href='/x'>some link</a></p>"
    between = f"<h1>Title</h1><p>{LONG}</p><p>Short line here.</p><p>{LONG}</p>{link * 3}"
    beside = f"{link}<p>Short line here.</p>{link}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    assert "Short line" in html_text.main_texts([between], tree)[0]
    assert "Short line" not in html_text.main_texts([beside], tree)[0]


@pytest.mark.parametrize("part", ['<a "x', '<a ="x', "<div>", "</x>", "<p><b>", "<!--", "<a href='\"", "<td>x", "<svg>", "<a <", "<div>x</y>"])
def test_a_megabyte_of_broken_markup(part):
    start = time.perf_counter()
    html_text.main_texts([part * (1_000_000 // len(part))], html_text.fitted())
    assert time.perf_counter() - start < 20


def test_an_article_may_begin_the_page():
    page = f"<article><p>{LONG}</p><p><a href='/x'>Linked line</a></p><p>{LONG}</p></article><footer>x</footer>"
    assert html_text.main_texts([page], html_text.fitted())[0] == f"{LONG} Linked line {LONG}"


PROSE = "It is a long sentence of running prose, as articles have it, with enough words in a row to be read and a full stop at its end."


@pytest.mark.parametrize("page, text", [("<p>Hello</p>", "Hello"), ("Just text", "Just text"), ("<h1>Title</h1><p>Short words here</p>", "Title Short words here"), ("<nav><a>Home</a></nav><p>Hello there</p>", "Hello there")])
def test_short_pages_are_kept(page, text):
    assert html_text.main_texts([page], html_text.fitted()) == [text]


@pytest.mark.parametrize("end", ["", f"<p>{PROSE}</p>"])
def test_linked_items_of_an_article_are_kept(end):
    page = f"<article><h1>T</h1><p>{PROSE}</p><ul><li><a href='/x'>One link here</a></li><li><a href='/y'>Two</a></li></ul>{end}</article>"
    want = f"T {PROSE} One link here Two" + (f" {PROSE}" if end else "")
    assert html_text.main_texts([page], html_text.fitted()) == [want]


@pytest.mark.parametrize("after", [f"<div class='discussion-thread'><p>{PROSE} {PROSE}</p></div>", f"<div class='q7'><h3>3 responses</h3><p>Anna, 3 days ago</p><p>{PROSE} {PROSE}</p><p><a href='#'>Reply</a></p></div>"])
def test_what_readers_say_goes(after):
    assert html_text.main_texts([f"<article><p>{PROSE}</p></article>{after}"], html_text.fitted()) == [PROSE]
