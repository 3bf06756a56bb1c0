import random

import pytest

from lectern.llm.html import render, render_pages


def test_layout():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><h1>Big  title</h1>
    <p>one<p>two &amp; <b>three</b><br>four<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>y</ol>
    <table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td colspan=2>all of it</table>
    <div hidden>no</div><span style="Display : none">no</span><div>left</div><div>right</div><pre> a
  b</pre><script>"</p>" no</script><template>no</template>tail<!-- no -->end"""
    assert render(page) == "\n".join(
        ["Big title", "", "one", "", "two & three", "four", "", "- a", "- b", "  - c", "- d", "", "3. x", "4. y", "",
         "Name       Qty", "Apple pie  3", "all of it", "", "left", "right", "", " a", "  b", "", "tailend"]
    )


def test_repair():
    assert render("a</b>b") == "ab" and render("1 < 2 & 3") == "1 < 2 & 3"
    assert render("<p>x<p>y</div>z") == "x\n\nyz"
    assert render('<a title="1 > 0">link</a>') == "link" and render("<a title='x>text") == "text" and render("a <b c") == "a"
    assert render("<table><td>loose<td>cells</table>") == "loose  cells"
    assert render("<table><tr><td>日本<td>b<tr><td>abcd<td>c</table>") == "日本  b\nabcd  c"
    assert render("<dl><dt>term<dd>said<dt>next</dl>") == "term\n  said\nnext"


def test_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>"), (4, None, "<div>" * 5000 + "deep" + "</div>" * 5000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = sorted((r["page_id"], r["text"]) for r in render_pages(pages).collect())
    assert got == [(1, ""), (2, ""), (3, "x"), (3, "x"), (4, "deep")]
    assert render_pages(pages.limit(0)).count() == 0
    assert render("<p>word</p>" * 20_000).count("word") == 20_000


def test_cells_within_other_elements():
    assert render("<table><colgroup><col><tr><td>x</table>") == "x"
    assert render("<table><colgroup><col><tbody><tr><td>x</table>y") == "x\n\ny"
    assert render("<table><colgroup><td>x<td>y</table>") == "x  y"
    assert render("<table><font><tr><td>a<td>b<tr><td>c</font></table>") == "a  b\nc"
    assert render("<table><tr><b><td>a<td>b</b></table>") == "a  b"
    assert render("<table><tr><form><td>a</td><td>b</td></form></tr></table>") == "a  b"
    assert render("<table><center><tr><td>a</center><tr><td>b</table>") == "a\nb"
    assert render("<table><font><td>a<td>b<tr><td>c</table>") == "a  b\nc"
    assert render("<tr><td>x") == "x" and render("<td>x") == "x" and render("<body><tr><td>x<td>y") == "x  y"
    assert render("<div><td>x</td></div>") == "x" and render("a<div><td>x</td>\n<td>y</td></div>b") == "a\nx  y\nb"
    assert render("<tr><td>aa<td>b</tr>\n<tr><td>c<td>d</tr>") == "aa  b\nc   d"
    assert render("<ul><li><tr><td>x</ul>") == "- x" and render("<table><tr><td>a<table><tr><td>b</table></table>") == "a\n\nb"
    assert render("<table>" + "<div>" * 5000 + "<td>deep</table>") == "deep"


def test_formulas_drawings_and_options():
    assert render("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b") == "a x=2 b"
    assert render("<math><mfrac><mn>1</mn><mn>2</mn></mfrac><mtr><mtd>3</mtd><mtd>4</mtd></mtr></math>") == "1 2 3 4"
    drawing = "<svg><title>no</title><desc>no</desc><defs/><g>no<path d='z'/><text x=1>one<tspan>s</tspan></text><text/><text>two</text></g><metadata>no</metadata></svg>"
    assert render(f"a {drawing} b") == "a ones two b"
    assert render("<svg><foreignObject><p>in</p></foreignObject></svg>out") == "in\n\nout"
    assert render("<svg><path><p>after") == "after" and render("<div hidden><svg><text>no</text></svg></div>x") == "x"
    assert render("<p>pick <select><option>a<option selected>b &amp; c<option>d</select> now") == "pick b & c now"
    assert render("<select>no<optgroup label=x><option disabled>a<option>b</optgroup><option>c</select>") == "b"
    assert render("<select multiple><option>a</option><div><option label=B>b</option></div></select>") == "a B"
    assert render("<table><tr><td><select><option>a</td><td>b</table>") == "a  b" and render("<select></select>x") == "x"
    assert render("<datalist><option>no</datalist>x<option>y</option>") == "xy"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>c</table>", "wide one  x\na  b      c"),
        ("a&nbsp;&nbsp;b   c", "a\u00a0\u00a0b c"),
        ("<details><summary>more</summary>gone<p>too</p></details>", "more"),
        ("<details open><summary>more</summary>here</details>", "more\nhere"),
        ('<div style="visibility:hidden">no<span style="visibility: visible">yes</span></div>', "yes"),
        ('<div style="display:none">no<span style="visibility: visible">no</span></div>', ""),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
        ("<ol type=a start=26><li>z<li>aa</ol>", "z. z\naa. aa"),
        ("<ol type=I><li>x<li><ol><li>y</ol></ol>", "I. x\nII. 1. y"),
        ('<input value="typed"> <input type=hidden value=no> <input type=password value=no>', "typed"),
    ],
)
def test_layout_of_attributes(page, text):
    assert render(page) == text


def _plain(parts):
    """A second renderer for pages of paragraphs, lists and simple tables, written as what a reader would see."""
    out = []
    for kind, body in parts:
        if kind == "p":
            out.append(" ".join(body.split()))
        elif kind in ("ul", "ol"):
            out.append("\n".join((f"{i}. " if kind == "ol" else "- ") + x for i, x in enumerate(body, 1)))
        else:
            wide = [max(len(r[i]) for r in body) for i in range(len(body[0]))]
            out.append("\n".join("  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in body))
    return "\n\n".join(out)


def test_against_a_second_renderer():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(1, 6)))
    for _ in range(300):
        parts, html = [], ["<html><head><title>no</title><style>p{}</style></head><body>"]
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice(["p", "ul", "ol", "table"])
            if kind == "p":
                words = [word() for _ in range(rng.randint(1, 8))]
                parts.append((kind, " ".join(words)))
                html.append("<p>" + rng.choice([" ", "\n ", "  "]).join(f"<b>{w}</b>" if rng.random() < 0.2 else w for w in words) + rng.choice(["", "</p>"]))
            elif kind == "table":
                columns = rng.randint(1, 4)
                rows = [[word() for _ in range(columns)] for _ in range(rng.randint(1, 4))]
                parts.append((kind, rows))
                end = rng.choice(["", "</td>"])
                html.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}{end}" for c in r) for r in rows) + "</table>")
            else:
                items = [word() for _ in range(rng.randint(1, 5))]
                parts.append((kind, items))
                html.append(f"<{kind}>" + "".join(f"<li>{x}" + rng.choice(["", "</li>"]) for x in items) + f"</{kind}>")
        assert render("".join(html)) == _plain(parts)


def test_long_and_deep_pages():
    assert render("x" * 300_000) == "x" * 300_000
    assert render("<div>" * 20_000 + "deep") == "deep"
    assert render("<a " * 50_000).strip() == ""
