import random
import re
import time

import pytest

from waterspark.llm.html_text import extract_text, page_text

CASES = [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<b>x <p>y</b> z", "x\n\ny z"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><th>Name<th>N<tr><td>kiwi<td>22</table>", "Name  N\nkiwi  22"), ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na  b"),
    ("<table><tr><td>中文<td>x<tr><td>abcdef<td>y</table>", "中文    x\nabcdef  y"), ("a<script>if (1<2) '</p>'</script>b", "ab"), ("<title>t</title>x", "x"),
    ("<div hidden>a</div><p style='color:red; display : none'>b</p><i style=visibility:hidden>c</i>d", "d"), ("a &amp; b &lt;c&gt; &eacute;", "a & b <c> é"),
    ("a < b <3 </ >x", "a < b <3 x"), ("<!-- a --><!doctype html>x<!-- open", "x"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("x<div a='1>2'>y", "x\ny"),
    ("cut <div class=\"", "cut"), ("  a \n\t b  ", "a b"), ("<p> a <b> b </b> c</p>", "a b c"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("</p>x</div></b>", "x"),
    ("<head><title>t</title><p>x", "x"), ("<select><option>a<option>b</select>", "a\nb"), ("<noscript>n</noscript><template>t</template>v", "v"), ("<blockquote>q</blockquote>r", "  q\n\nr"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert page_text(page) == text


@pytest.mark.parametrize("tag", ["script", "STYLE", "title", "textarea", "xmp", "iframe"])
def test_letters_that_grow_in_lower_case(tag):
    seen = tag in ("textarea", "xmp")
    for before, inside in (("\u0130stanbul", "x"), ("\u0130" * 20, "x"), ("a", "\u0130\u0130"), ("\u0130\u0130", "\u0130y")):
        page = f"<body>{before}<{tag}>{inside}</{tag.swapcase()}><p>rest</p></body>"
        words = page_text(page).replace(before, before + " ", 1).split()
        assert words == [before, *([inside] if seen else []), "rest"]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<p>" * 50_000, "<table><tr><td>" * 2000 + "z", "<" * 100_000, '<a "' * 20_000, "<!--" * 20_000, "<script>" * 20_000, "<ul><li>" * 3000 + "k"])
def test_broken_pages_end_soon(page):
    began = time.time()
    page_text(page)
    assert time.time() - began < 20


BLOWING = [
    "<table><tr><td>" + "x" * 160_000 + "<td>y" + "<tr><td>a<td>b" * 1_600 + "</table>",  # one wide cell, many rows
    "<table>" + "<tr><td colspan=1000>a<td>b" * 2_000 + "</table>",  # wide spans
    "<table><tr>" + "<td>" * 3_000 + "a<td>" + "b<br>" * 3_000 + "</table>",  # many cells, one high
    "<table>" + "<tr><td>" + "w" * 100 + "<td>v" + "<tr><td>a<td>b" * 3_000 + "</table>",  # narrow below a wide one
    "<table><tr><td>" + "k" * 110 + "<td>" + "<table><tr><td>a<td>" * 11 + "<br>b" * 5_000,  # nested
    "<table><tr><td colspan=1000>a<td>b</table>" * 2_000,  # many small ones
]


@pytest.mark.parametrize("page", BLOWING)
def test_tables_do_not_grow(page):
    began = time.time()
    text = page_text(page)
    assert len(text) <= 8 * len(page) and time.time() - began < 20
    plain = "".join(re.sub("<[^>]*>", "", page).split())
    assert sorted("".join(text.split())) == sorted(plain)


def test_the_long_cell_costs_no_padding():
    page = BLOWING[0]
    assert len(page_text(page)) < 2 * len(page)
    rows = page_text(page).split("\n")
    assert rows[0] == "x" * 160_000 + "  y" and set(rows[1:]) == {"a  b"}


def test_random_tables_as_laid_out_cell_by_cell():
    """Plain layout of small tables: every cell by itself, padded to its column."""
    rnd = random.Random(5)
    for _ in range(300):
        table = [["".join(rnd.choice("abc中 ") for _ in range(rnd.randint(0, 9))).strip() for _ in range(rnd.randint(2, 4))] for _ in range(rnd.randint(1, 5))]
        table = [[re.sub(" +", " ", cell) for cell in row] for row in table]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{cell}" for cell in row) for row in table) + "</table>"
        seen = [row for row in table if any(row)]
        wide = [max(sum(2 if ch == "中" else 1 for ch in row[c]) for row in seen if c < len(row)) for c in range(max(map(len, seen), default=0))]
        lines = []
        for row in seen:
            line = ""
            for c, cell in enumerate(row):
                line += cell + " " * (wide[c] - sum(2 if ch == "中" else 1 for ch in cell)) + "  "
            lines.append(line.rstrip())
        # Indentation of a first empty cell is part of the layout.
        assert page_text(page) == "\n".join(lines), page


def test_odd_rows(spark):
    rows = [(i, page) for i, (page, _) in enumerate(CASES)] + [(None, "<p>x"), (3, None), (3, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'t' AS text", "'u' AS url").repartition(3)
    want = sorted([(i, t) for i, (_, t) in enumerate(CASES)] + [(-1, "x"), (3, ""), (3, "")])
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in extract_text(pages).collect()) == want
    assert extract_text(pages.filter("page_id < 0")).collect() == []
