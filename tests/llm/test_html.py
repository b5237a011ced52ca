"""Visible text of pages: rules one by one, and the words of whole pages against a plain parser."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import types as T

from topicloom.llm import queries as Q
from topicloom.llm.html_text import extract_text, visible_text

from .common import CLASHING

CASES = {
    "paragraphs are set off": ("<p>a<p>b</p>c", "a\n\nb\n\nc"),
    "white space collapses": (" a \n\t b<span> c</span> <b> d</b>\xa0\xa0e", "a b c d  e"),
    "a cell ends with its row": ("<table><tr><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    "columns are aligned": ("<table><tr><th>name<th>n<tr><td>x<td>10<tr><td>longer name<td>7</table>", "name         n\nx            10\nlonger name  7"),
    "spans": ("<table><tr><td colspan=2>wide<td>z<tr><td rowspan=2>A<td>B<td>C<tr><td>D<td>E</table>", "wide  z\nA  B  C\n   D  E"),
    "heads first, feet last": ("<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
    "stray content goes before a table": ("<table>x<tr>y<td>z</table>", "xy\n\nz"),
    "cells of several lines": ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    "a table in a cell": ("<table><tr><td><table><tr><td>a<td>b</table><td>c</table>", "a  b  c"),
    "lists": ("<ul><li>a<li>b<ol start=9><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  9. c\n  10. d\n- e"),
    "numbers": ("<ol reversed><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n6. c"),
    "preformatted": ("<pre>\na  b\n  c</pre>", "a  b\n  c"),
    "definitions": ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    "quotes": ("a<blockquote>q<p>r</blockquote>b", "a\n\n  q\n\n  r\n\nb"),
    "margins are shared": ("<div><ul><li>a</ul></div><div>b</div>", "- a\n\nb"),
    "head and scripts": ("<title>t</title><script>var a='</p>';</script><style>p{}</style>x<noframes>n</noframes>", "x"),
    "head ends with what isn't its own": ("<head><title>t</title><p>x", "x"),
    "hidden": ("a<div hidden>b</div><p style='DISPLAY : none !important'>c</p><input type=hidden value=d><template>e</template>f", "af"),
    "visibility is inherited and can be set back": ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>", "b"),
    "style sheets": ("<style>/* .k{display:none} */ .x, p.y{display:none} #z{visibility:hidden}</style><p class='k y'>a<div class=y>b</div><i class=x>c</i><u id=z>d</u><s class=k>e</s>", "b\ne"),
    "closed and open": ("<details><summary>s</summary>x</details><details open><summary>t</summary>y</details><dialog>z</dialog>", "s\nt\ny"),
    "entities": ("&lt;b&gt; &amp;amp; &eacute;&#33;&nosuch;", "<b> &amp; é!&nosuch;"),
    "no tags": ("a < b <3 <> </> c", "a < b <3 <> c"),
    "comments": ("a<!-- <p>x</p> -->b<!doctype html>c<?php d ?>e<!-->f--> g", "abcef--> g"),
    "an unclosed comment": ("a<!-- b", "a"),
    "a tag that never ends": ("a<b c='", "a"),
    "form controls": ("<select><option>a<option>b</select><button>c</button><textarea> d\n e</textarea><input value=f>", "a\nb\nc\n d\n e\nf"),
    "end tags of what isn't open": ("</div>a</p>b</br>c</td>", "a\n\nb\nc"),
    "quotes in attributes": ("<a title='>' data-x=\"</a>\" href=x>y</a>", "y"),
    "raw text of any case": ("<SCRIPT>a</ScRiPt >b", "b"),
    "headings end each other": ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_rule(name):
    html, expected = CASES[name]
    assert visible_text(html) == expected


@pytest.mark.parametrize("part, n", [("<div>", 50_000), ("<p><button><div>", 20_000), ("<table>", 20_000), ("<table><tr><td>", 5_000), ("<ul><li>", 5_000), ("<", 50_000), ("<a b='", 50_000), ("</a", 50_000), ("<!--", 50_000), ("<p", 50_000), ("<tr><td colspan=1000 rowspan=1000>x", 200), ("<b></i>", 50_000)])
def test_pages_that_are_made_to_be_slow(part, n):
    visible_text("<table>" + part * n + "end")
    visible_text(part * n + "</p></div></td>" * 1000)


def test_wide_cells_are_not_padded_without_bound():
    html = "<table>" + f"<tr><td>{'x' * 5000}<td>y" + "<tr><td>a<td>b" * 5000 + "</table>"
    assert len(visible_text(html)) < 60_000


def test_columns_as_wide_as_their_cells():
    html = f"<table><tr><td>{'x' * 100}<td>y<tr><td>a<td>b</table>"
    assert visible_text(html) == f"{'x' * 100}  y\na  b" and visible_text(html, None) == f"{'x' * 100}  y\na{' ' * 101}b"


class Words(HTMLParser):
    """Words of all text outside of what is never shown, in the order of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("title", "script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("title", "script", "style")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


SHEETS = {
    "print": ("@media print { .a, nav { display: none } } .b{display:none}", "a c n"),
    "narrow screens": ("@media (max-width:600px){ .a{display:none} .b{display:none} } .c{visibility:hidden}", "a b n"),
    "wide screens": ("@media only screen and (min-width: 40em) and (orientation:landscape){.a{display:none}} @media (width < 700px){.b{display:none}}", "b c n"),
    "lists of media": ("@media print, (max-width: 2000px) {.a{display:none}} @media not screen{.b{display:none}} @media not print{.c{display:none}}", "b n"),
    "what can't be told": ("@media (hover:none){.a{display:none}} @media not (hover){.b{display:none}} @supports (x:y){.c{display:none}}", "a b c n"),
    "media in media": ("@media screen{@media print{.a{display:none}} .b{display:none}} @media print{@media screen{.c{display:none}}}", "a c n"),
    "layers and statements": ("@charset 'x;{'; @import url(x.css); @layer p, q; @layer p{.a{display:none}} @font-face{font-family:b} .b{display:none}", "c n"),
    "strings": (".q::before{content:'} .a{display:none}'} .b{content:\"{\";display:none}", "a c n"),
    "rules in rules": (".a{color:red; .b{display:none} display:none} .c{display:none}", "b n"),
    "ends": (".x{} } .a{display:none} .b{display:none} @media print{.c{display:none", "a c n"),
}


@pytest.mark.parametrize("name", SHEETS)
def test_rules_of_sheets_that_hold_on_a_screen(name):
    sheet, expected = SHEETS[name]
    page = f"<style>{sheet}</style><i class=a>a </i><i class=b>b </i><i class=c>c </i><nav>n</nav>"
    assert visible_text(page).split() == expected.split()


def test_media_of_a_sheet():
    assert visible_text("<style media=print>p{display:none}</style><style media='screen, print'>b{display:none}</style><p>a<b>b</b>") == "a"


def test_long_sheets_of_marks():
    for mark in (";", "}", "{", "a{", "'", '"', "\\"):
        assert visible_text(f"<style>display {mark * 200_000}</style>a") == "a"


@pytest.mark.parametrize("depth", range(93, 107))
@pytest.mark.parametrize("outer", ["div", "font"])
def test_tables_at_the_greatest_depth(depth, outer):
    table = "<table><caption>a</caption><tbody><tr><td>b<p>c<td><table><caption>d</caption>e<tr><td>f<b>g</b><table><tr><td>h</table></table><tr><th>i</table>"
    words = visible_text(f"<{outer}>" * depth + table + "j").split()
    assert sorted("".join(words)) == list("abcdefghij")


def test_op6_on_pages(spark, medium):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{medium}/pages.parquet").collect()}
    found = {r.page_id: r.text for r in Q.op6_html(spark, medium).collect()}
    assert found.keys() == pages.keys()
    for i, html in pages.items():
        parser = Words()
        parser.feed(html)
        parser.close()
        assert [w for w in found[i].split() if w != "-"] == [w for w in parser.words if w != "-"]
        assert found[i].startswith("- ") and "\n\n" in found[i]


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])
    rows = [(1, None), (2, ""), (None, "<p>a"), (3, "<p>b"), (3, "<p>b"), (4, "<p>" + "word " * 100_000)]
    found = extract_text(spark.createDataFrame([(i, h, "old", *CLASHING) for i, h in rows], schema)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, None), (2, ""), (None, "a"), (3, "b"), (3, "b"), (4, ("word " * 100_000).strip())], key=str)
    assert extract_text(spark.createDataFrame([], schema)).collect() == []
