"""HTML as Markdown: structure by cases, words against a plain walk over the same pages."""

import re
from html.parser import HTMLParser

import pytest

from sparkquarry.functions.markdown import DROPPED, VOID, convert, page_content, selector_parts

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<div>one<div>two<div>three</div>four</div>five</div>six": "one\n\ntwo\n\nthree\n\nfour\n\nfive\n\nsix",
    "<nav>x<nav>y</nav>z</nav>kept": "kept",
    "<nav><div>x</nav>kept</div>": "kept",
    "a</p>b</div>c": "abc",
    "<h2> A\n b </h2>text": "## A b\n\ntext",
    "<p>x <b>y</b> <em>z</em><br>w <code>k()</code>": "x **y** *z*\nw `k()`",
    "<b></b>x<a href='/e'> </a>": "x",
    "<a href='/a b'>l<b>m</b></a> <a>n</a>": "[l**m**](/a b) n",
    "<img src=i.png alt=pic><img src=j.png>": "![pic](i.png)",
    "<ul><li>a<li>b<ol><li>c</li><li>d</ol><li>e</ul>": "- a\n- b\n  1. c\n  2. d\n- e",
    "<ol start=4><li>a<li>b</ol>": "4. a\n5. b",
    "<ul><li><p>a<p>b</ul>": "- a\n\n  b",
    "<blockquote>q<blockquote>r</blockquote></blockquote>s": "> q\n\n> > r\n\ns",
    "<pre>  a\n   <b>b</b> &lt;c&gt;</pre>": "```\n  a\n   b <c>\n```",
    "<table><tr><th>a<th>b<tr><td>1|2<td><p>x</p><p>y</p></table>": "| a | b |\n| --- | --- |\n| 1\\|2 | x y |",
    "<table><tr><td>a<table><tr><td>in</table>b</table>": "| a in b |\n| --- |",
    "&amp;&nbsp;&eacute;&#8364;&unknown; &lt;p&gt;": "& é€&unknown; <p>",
    "<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>yes": "yes",
    "a<hr>b": "a\n\n---\n\nb",
    "": "",
    "<": "<",
}


@pytest.mark.parametrize("html", CASES)
def test_structure(html):
    assert convert(html)[1].replace("\xa0", " ") == CASES[html]


def test_titles_and_selectors():
    assert convert("<title> A &amp; b </title><h1>c</h1>") == ("A & b", "# c")
    assert convert("<h1>c <i>d</i></h1>")[0] == "c d" and convert(None) == ("", "")
    page = "<div id=a>1<p>2</div><div class='x doc'><div>3</div>4</div><main>5<div class=doc>6</div></main>7"
    assert convert(page, "#a")[1] == "1\n\n2" and convert(page, "div.doc")[1] == "3\n\n4\n\n6" and convert(page, "main, .x")[1] == "3\n\n4\n\n5\n\n6"
    assert convert(page, "#none")[1] == ""
    for wrong in ("a > b", "[x]", "a:b"):
        with pytest.raises(ValueError):
            selector_parts(wrong)


class Plain(HTMLParser):
    """All text outside dropped elements, by depth alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in DROPPED and tag not in VOID

    def handle_endtag(self, tag):
        self.depth -= tag in DROPPED and self.depth > 0

    def handle_data(self, data):
        self.text.append(data if not self.depth else "")


def letters(text):
    return re.sub(r"[\W_\d]+", "", text)


def test_no_letter_is_lost_or_added_on_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(4)
    rows = pages.select("html", page_content(pages["html"]).alias("page")).collect()
    assert len(rows) > 100
    for row in rows:
        plain = Plain()
        plain.feed(row.html)
        plain.close()
        made = re.sub(r"\]\([^)\s]*\)", "]", row.page.markdown)
        assert letters(made) == letters("".join(plain.text))
