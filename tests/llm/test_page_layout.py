"""Rendered pages, whole: visibility by styles, white space, lists, scripts; text and layout written by hand."""

import time

import pytest

from terrastat.llm.html_render import extract_text, visible_text
from terrastat.llm.page_styles import declarations, rules_of

SHEET = "<style>.h{display:none} #a .k>b{visibility:hidden} @media print{p{display:none}} .h.s{display:block}</style>"
PAGES = [
    ('<p style="display:none!important;display:block">x</p>y', "y"),
    ('<p style="display:none;display:block">x</p>y', "x\n\ny"),
    (SHEET + '<p class="h">no</p><p class="h s">yes</p><div id=a><i class=k><b>no</b>c</i></div>', "yes\n\nc"),
    (SHEET + "<div id=a><i class=k><u><b>kept</b></u></i></div>", "kept"),
    ("<style>p{display:none}</style><p style='display:block'>inline wins</p><p>no</p>", "inline wins"),
    ("<style>p{display:none!important}</style><p style='display:block'>no</p>x", "x"),
    ("<style>#i{display:block}p{display:none}</style><p id=i>id wins</p>", "id wins"),
    ("<style>p{display:none}p{display:block}</style><p>later wins</p>", "later wins"),
    ("<style>/* p{display:none} */ p:hover{display:none} p~p{display:none}</style><p>a<p>b", "a\n\nb"),
    ("<style media=print>p{display:none}</style><style type=text/plain>p{display:none}</style><p>p", "p"),
    ("<style>@font-face{x:y} @media screen{.q{display:none}} [data-x='1']{display:none}</style><p class=q>no<p data-x=1>no<p data-x=2>yes", "yes"),
    ("<p class=z>no</p>kept<style>.z{display:none}", "kept"),
    ("<script><style>.z{display:none}</style></script><p class=z>kept", "kept"),
    ("<style>ul > li{display:none}</style><ul><li>a</ul><ol><li>b</ol>", "1. b"),
    ("<p hidden style='display:block'>shown</p><p hidden>not</p>", "shown"),
    ("<div style=visibility:hidden>a<span style=visibility:visible>b</span></div>", "b"),
    ("<pre>\na\n  b</pre>", "a\n  b"),
    ("<pre>\n\na</pre>", "\na"),
    ("<pre style='white-space:normal'>a\n   b</pre>", "a b"),
    ('<div style="white-space:pre">a  b\nc</div><div style="white-space:pre-line">a  b\nc</div>', "a  b\nc\na b\nc"),
    ("<style>.w{white-space:pre}</style><table><tr><td class=w>a  b<td>c</table>", "a  b  c"),
    ("<ol type=a start=26><li>x<li>y</ol><ol type=I start=3><li>q<li type=1>r</ol>", "z. x\naa. y\n\nIII. q\n4. r"),
    ("<ol type=i reversed><li>x<li>y</ol><ol type=A start=0><li>z</ol>", "ii. x\ni. y\n\n0. z"),
    ("<script><!--<script></script>--></script>ok", "ok"),
    ("<script><!-- x </script>ok", "ok"),
    ("<script><!--><script></script>ok", "ok"),
    ("a<plaintext><b>t</b>\n</plaintext>", "a\n<b>t</b>\n</plaintext>"),
    ("<h1>T</h1><p>one<br>two<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><th>n<th>long name<tr><td>1<td>x</table>end", "T\n\none\ntwo\n\n* a\n  * b\n* c\n\nn  long name\n1  x\n\nend"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_page(html, text):
    assert visible_text(html) == text


def test_declarations():
    assert declarations("display : none ! important ; DISPLAY:block") == {"display": (True, "none")}
    assert declarations("color:red;display:block!ie;x") == {} and declarations("") == {}
    assert rules_of(["p{color:red}", "a{display:none", "}}{", ">p{display:none}", "p>{display:none}", "p,,q r{display:none}"])[0][3] == {"display": (False, "none")}
    assert len(rules_of(["p,q r,s:x{visibility:hidden}"])) == 2


def test_long_styled_pages_are_linear(spark):
    sheet = "<style>" + "".join(f".c{k} .d{k}{{display:none}}" for k in range(40)) + "</style>"
    began = time.time()
    visible_text(sheet + "<div class=c1><p class=d2>x</p>" * 3000)
    assert time.time() - began < 20
    rows = [(1, sheet + "<p class=c3>a<b class=d3>no</b></p>"), (2, None), (3, ""), (None, "x")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: "a", 2: "", 3: "", None: "x"}
