import html
import re

import pytest

from tests.llm.conftest import SF
from tidemark.llm import queries as Q
from tidemark.llm.html_text import extract, main_blocks, main_text


def by_hand(page):
    """The pages of the test data mark their article and put nothing else into it."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inner)
    texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", "\n"))).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_query_against_test_data(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = Q.op4_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == by_hand(pages[r.page_id].html)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


UNMARKED = """<html><head><title>T</title></head><body class="has-sidebar">
<header class="site"><h1>Site</h1><a href="/">Home</a></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><ul class="menu"><li><a href="#">A</a><li><a href='#'>B</a></ul>
<div class="content"><h2>Head &amp; more</h2><p>First para is long enough to count as running text, isn't it?
<a href="x">link</a> yes &lt;b&gt; &#8364; &nbsp; x<p>Short.<p>Another paragraph follows with <em>inline</em> text<br>and
a break, long enough to be counted as text.<form><input name=q><label>Search</label></form></div>
<div class="comments"><p>A reader says a lot of things here that nobody wants to find in the main text of an article.</p>
</div></div><footer>&copy; 2020</footer>"""


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []),
        ("plain < text & more", ["plain < text & more"]),
        ("<p>x", ["x"]),
        ("<!-- <p>no</p> --><p>a&amp;b &am &unknown; &#x41;</p>", ["a&b &am &unknown; A"]),
        ("<article><h1>T</h1><div class='ad'><p>buy</div><p>one <!-- c > --> two<script>'<p>x</p>'</script></p>"
         "<aside>s</aside><p>3</article><div>out</div>", ["T", "one two", "3"]),
        ("<article><p>a<b>b<p>c</article>", ["ab", "c"]),
        ("<article>x<style>p{}</style><form>f</form><section id='comments'>c</section></article>", ["x"]),
        ("<main><article class='comment'>reader</article><p>text</p></main>", ["text"]),
        ("<nav>menu<ul><li>x</ul></nav><article><p title='a > b'>q</p></article><footer>f</footer>", ["q"]),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", ["one", "two", "c", "d"]),
        (UNMARKED, [
            "Head & more",
            "First para is long enough to count as running text, isn't it? link yes <b> € x",
            "Short.",
            "Another paragraph follows with inline text and a break, long enough to be counted as text.",
        ]),
    ],
)
def test_pages(page, blocks):
    assert main_blocks(page) == blocks


LONG_TEXT = "This paragraph is the main text of the page and goes on for long enough that it counts as running text."


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<div class='page has-sidebar'><article><p>text</p></article></div>", ["text"]),
        ("<div id='content-with-nav'><p>text</p></div>", ["text"]),
        ("<section class='post comments-open'><p>text</p></section>", ["text"]),
        ("<div class='sidebar-layout'><p>out of it, and longer than the article</p><article>text</article></div>", ["text"]),
        (f"<div class='widget'><p>{LONG_TEXT}</p><div class='sidebar'>side</div></div><p>end", [LONG_TEXT, "end"]),
        ("<article><pre><code>x = 1 <span class='comment'># one</span></code></pre></article>", ["x = 1 # one"]),
        (f"<article>{LONG_TEXT}</article><div class='related-posts'><article>teaser</article></div>", [LONG_TEXT]),
        (f"<p>{LONG_TEXT}<div class='cookie-bar'>c</div><div class='comments'><div class='comment'>{LONG_TEXT[:60]}</div>"
         f"<div class='comment'>{LONG_TEXT[:60]}</div></div>", [LONG_TEXT]),
    ],
)
def test_class_names_of_wrappers(page, blocks):
    assert main_blocks(page) == blocks


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<main>teaser</main><div><h1>Head</h1><p>{LONG_TEXT}<p>{LONG_TEXT}</div>", ["teaser", "Head", LONG_TEXT, LONG_TEXT]),
        (f"<div><p>{LONG_TEXT * 4}</div>" + "<article>card</article>" * 30, [LONG_TEXT * 4, *["card"] * 30]),
        (f"<div>{LONG_TEXT}</div><article>{LONG_TEXT}</article>", [LONG_TEXT]),
        ("<article><p>a</p><ul><li>" + "<li>".join(f"<a>{k}</a>" for k in range(6)) + "</ul><p>b</article><p>out",
         ["a", *"012345", "b"]),
        (f"<h2>Head</h2><div class='share'>s</div><div class='advert'>a</div><aside>x</aside><p>{LONG_TEXT}", ["Head", LONG_TEXT]),
        (f"<p><a>link</a><h1>Head</h1><p>by A<p>May 1<p>two minutes<p>{LONG_TEXT}", ["Head", "by A", "May 1", "two minutes", LONG_TEXT]),
        (f"<p>{LONG_TEXT}" + "<p><a>link</a>" * 3 + "<p>lost" + "<p><a>link</a>" * 3, [LONG_TEXT]),
    ],
)
def test_windows_decide_on_all_pages(page, blocks):
    assert main_blocks(page) == blocks


def test_long_and_broken_pages_end():
    assert main_text("<" * 20_000) == "<" * 20_000
    assert main_text("<article>" + "<p>x" * 20_000).count("x") == 20_000
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<p " + "a='" * 2000) is not None


def test_edges(edge, empty, edge_rows):
    got = extract(edge, id_col="doc_id", url_col="source", html_col="text").collect()
    want = [(r[0], r[3], " ".join((r[1] or "").split())) for r in edge_rows]
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract(empty, id_col="doc_id", url_col="source", html_col="text").count() == 0
