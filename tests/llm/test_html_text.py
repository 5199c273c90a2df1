"""Blocks, training and extraction on pages of the table and of other layouts."""

import html as entities
import re

import pytest

from faultline.llm import common, html_text


def expected(page):
    """The text of this table's pages, whose articles hold headings and paragraphs."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", body)]
    lines = [re.sub(r"\s+", " ", entities.unescape(b)).strip() for b in blocks]
    return "\n".join(x for x in lines if x)


def test_pages_of_the_table(spark):
    common.prepare(spark)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_text.extract_pages(pages).collect()
    assert len(rows) == pages.count()
    assert all(r.text == expected(r.html) for r in rows)


LAYOUT = """<html><head><title>T</title></head><body><header><h1>Site name</h1><nav><a href=x>Home</a></nav></header>
<div id="cookie-notice">We use cookies.</div><div class="sidebar"><p>Popular posts you may like, today.</p></div>
<OPEN><header class="entry-header"><h1>Real title &amp; more</h1></header><p>First   para<b>graph</b> here, long enough to be text.
<p>Second<br>one.<aside class="ad">Buy now!</aside><p>Third &lt;x&gt; para.</p><form><label>Email</label><input></form>
<div class="comments"><p>Nice article, I liked it a lot.</p></div></CLOSE>
<section class="reader-comments"><h2>Comments</h2><p>Me too, what a nice one it was.</p></section>
<script>if (a < b) document.write("</p><p>no</p>")</script><footer>&copy; 2024</footer></body></html>"""
WANT = "Real title & more\nFirst paragraph here, long enough to be text.\nSecond one.\nThird <x> para."


@pytest.fixture(scope="module")
def field(spark):
    return html_text.fit_field(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("opened, closed", [("article", "article"), ("main", "main"), ('div class="post-content"', "div")])
def test_other_layouts(field, opened, closed):
    page = LAYOUT.replace("OPEN", opened).replace("CLOSE", closed)
    assert html_text.extract(page, field) == WANT


@pytest.mark.parametrize("page", [None, "", " ", "<html></html>", "<script>x</script>", "<!-- only", "<", "<p", "<a href='x"])
def test_pages_without_text(field, page):
    assert html_text.extract(page, field) in ("", "<", "<p", "<a href='x")


def test_long_and_broken_pages(field):
    body = "<p>A paragraph of some words that ends here.</p>" * 5000
    assert html_text.extract(f"<article>{body}</article>", field).count("\n") == 4999
    assert html_text.extract("<article><p>One &amp; two &#233; &unknown; &lt;b&gt;.<p>" + "<i>" * 3000 + "deep text here.", field) \
        == "One & two é &unknown; <b>.\ndeep text here."


def test_blocks_know_their_ancestors():
    blocks = html_text.leaf_blocks('<ul class="Main-Menu"><li><a href=/x>Go</a> now<li>Two</ul>tail')
    assert [b.text for b in blocks] == ["Go now", "Two", "tail"]
    assert blocks[0].linked == 2 and [t for t, _ in blocks[1].path] == ["ul", "li"] and blocks[2].path == ()
    assert blocks[0].path[0][1] == {"main", "menu"}


def test_tables(spark, field):
    common.prepare(spark)
    df = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<article><p>Hello there, reader.</p></article>", "u")],
                               "page_id long, html string, features string")
    got = html_text.extract_pages(df, field)
    assert sorted(r.text for r in got.collect()) == ["", "", "Hello there, reader."]
    assert html_text.extract_pages(df.limit(0)).count() == 0
    # No labelled page: the prior decides.
    assert html_text.extract_pages(df.where("html is null")).first().text == ""
