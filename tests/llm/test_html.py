"""Text of pages: hand-made layouts, malformed input, and the words of a plain parser."""

import os
import time
from html.parser import HTMLParser

import pytest

from tsreg.llm import html_text
from tsreg.llm.html_text import text_of

PAGES = {
    "": "",
    "plain": "plain",
    "<p>One <b>two</b>\n three<p>Four": "One two three\n\nFour",
    "a<br>b<br/>c</br>d": "a\nb\nc\nd",
    "<div>a</div>b<div>c": "a\nb\nc",
    "<h1>T</h1>x": "T\n\nx",
    "<ul><li>a<li>b<ol start=3><li>x<li value=9>y</ol><li>c</ul>z": "- a\n- b\n  3. x\n  9. y\n- c\n\nz",
    "<ul><li><p>a<p>b</ul>": "- a\n\n  b",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n    d\nu\n    e",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td>fig tree<td>2</table>": "Name      Qty\napple     10\nfig tree  2",
    "<table><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>": "a  b  c\nd     e",
    "<table><tr><td colspan=2>both<td>x<tr><td>1<td>2<td>3</table>": "both     x\n1     2  3",
    "<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>": "in  ner  out",
    "<table><tr><td>a<br>bb<td>c</table>": "a   c\nbb",
    "<pre> x\n   y</pre>": " x\n   y",
    "<script>var a='</p>';</script><style>p{}</style><!-- c --><title>t</title>x<noscript>n</noscript>": "x",
    "<head><title>t</title><p>body": "body",
    "<div hidden>a</div><p style='display: none !important'>b</p><i style=visibility:hidden>c<b style=visibility:visible>d": "d",
    "<blockquote>q<p>r</blockquote>s": "    q\n\n    r\n\ns",
    "&lt;&amp;&#233;&eacute;&nbsp;x 3 < 4": "<&éé x 3 < 4",
    "<textarea> a </textarea><input value=v><input type=hidden value=h>": " a  v",
    "<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details>": "s\ns\nyes",
    "<a title='a > b'>x</a><a title=\"unclosed>y": "xy",
    "</p></div>x</table>": "x",
    "<!-->x<!--->y<!doctype html>z<?php 1 ?>": "xyz",
    "<p>a</p>\n\n<p>b</p>\n": "a\n\nb",
    "a <b> b</b> c": "a b c",
    "<td>loose": "loose",
}


@pytest.mark.parametrize("page", PAGES)
def test_layout(page):
    assert text_of(page) == PAGES[page]


def test_deep_and_long_pages():
    assert text_of("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert text_of("<b><i>" * 20_000 + "deep").endswith("deep")
    assert text_of("<table><td>" * 300 + "x") == "x"
    assert len(text_of("<p>word " * 50_000).split()) == 50_000
    assert text_of('<a b="' * 20_000) == ""
    assert text_of("<" * 50_000) == "<" * 50_000
    assert text_of("<table><td colspan=999999 rowspan=999999>a<td>b</table>") == "a  b"


class Words(HTMLParser):
    """All character data outside of scripts, styles and titles, blocks apart."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attributes):
        self.skip += tag in ("script", "style", "title")
        self.out.append(" " if tag in html_text.BLOCK or tag == "br" else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.out.append(" " if tag in html_text.BLOCK else "")

    def handle_data(self, data):
        self.out.append("" if self.skip else data)


def words(page):
    parser = Words()
    parser.feed(page)
    parser.close()
    return [w for w in "".join(parser.out).split() if w != "-"]


DATA = "/root/testdata/sf0.001/pages.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="test tables are not here")
def test_all_words_of_the_table(spark):
    pages = spark.read.parquet(DATA)
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        assert [w for w in got[row.page_id].text.split() if w != "-"] == words(row.html)


def test_odd_rows(spark):
    rows = [(1, None, "t"), (1, None, "t"), (None, "<p>x", "t"), (2, "", "t"), (3, "<p>a<p>b", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_lines) for r in html_text.extract_text(pages).collect()), key=repr)
    assert got == sorted([(1, "", 0), (1, "", 0), (None, "x", 1), (2, "", 0), (3, "a\n\nb", 3)], key=repr)
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["SCRIPT", "Style", "TITLE", "textArea"])
def test_end_of_raw_elements_beside_letters_that_grow(tag):
    page = f"<p>\u0130stanbul</p><{tag}>raw \u0130 <b></{tag}><p>the rest</p>"
    assert "the rest" in text_of(page).split("\n") and "<b></" not in text_of(page)


def seconds(page):
    begin = time.perf_counter()
    text = text_of(page)
    return time.perf_counter() - begin, text


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + "x",
        "<p><table><td>" + "<b>" * 50_000 + "<div></div>" * 50_000 + "x",
        "<pre>" + "\n" * 200_000 + "x",
        "<p>" + "word " * 200_000,
        "<li>" * 200_000 + "x",
        "<p>a</b>" * 100_000,
        "<td>a" * 100_000,
        "<span>" * 100_000 + "</i>" * 100_000 + "x",
    ],
    ids=["blocks", "inline in a cell", "line feeds", "one line", "items", "strays", "cells", "inline"],
)
def test_time_follows_the_length(page):
    took, text = seconds(page)
    assert took < 5 and text


def test_wide_cells_keep_the_columns():
    wide = "w" * 61
    page = f"<table><tr><td>{wide}<td>b<tr><td>c<td>d</table>"
    assert text_of(page) == f"{wide}  b\nc{' ' * 62}d"
    wide = "w" * (html_text.WIDEST + 1)
    page = f"<table><tr><td>{wide}<td>b<tr><td>cc<td>d</table>"
    assert text_of(page) == f"{wide}\n    b\ncc  d"  # behind a wider cell the row goes on below
    many = "".join(f"<td>{'x' * 150}" for _ in range(100))
    lines = text_of(f"<table><tr>{many}<tr>{many}</table>").split("\n")
    assert max(map(len, lines)) <= html_text.LINE and sum(line.count("x") for line in lines) == 200 * 150
