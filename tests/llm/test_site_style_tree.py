"""Main text of pages with known articles."""

import html
import re

from pyspark.sql import types as T

from markwise.llm.batches import table
from markwise.llm.html_blocks import blocks_of
from markwise.llm.site_style_tree import extract_text, op3_html_extraction, style_tree

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


def texts(df):
    return {r.page_id: r.text for r in extract_text(df).collect()}


def test_parts_around_an_article_go(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="no-sidebar"><header>Site</header>
    <nav><ul><li><a href="x">Menu</a></ul></nav><div id="cookie-notice">We use cookies</div><div class=ad>Buy</div>
    <article><header><h1>A &amp; B</h1></header><p>One <b>two<br>three</b><p>Caf&eacute;&nbsp;x &copy 3 &lt;tag&gt;
    <ul><li>a<li>b</ul><script>var a = "<p>no</p>";</script><aside>see also</aside><form>mail <input></form>
    <!-- hidden --><table><tr><td>c<td>d</table></article><section class="comments"><p>Nice!</p></section>
    <aside>side</aside><footer>&copy; me</footer></body></html>"""
    df = spark.createDataFrame([(1, "http://h.example/a", page)], PAGES)
    assert texts(df)[1] == "A & B\n\nOne two three\n\nCafé x © 3 <tag>\n\na\n\nb\n\nc\n\nd"


def test_repeated_branches_of_a_host_go_by_their_entropy(spark):
    rows = [
        (i, f"https://h.example/{i}", f"<body><div class=x1>Home About</div><div class=x2><p>Text {i} of page.</p><p>More {i * i}.</p></div><div class=x3>All rights</div>")
        for i in range(12)
    ]
    rows.append((50, "https://other.example/", "<body><div class=x1>Home About</div>"))
    df = spark.createDataFrame(rows, PAGES)
    got = texts(df)
    assert all(got[i] == f"Text {i} of page.\n\nMore {i * i}." for i in range(12))
    assert got[50] == "Home About"
    importance = {(r.host, r.path): r.importance for r in style_tree(df).collect()}
    assert importance[("h.example", "/body/div.x")] < 0.5 or len({k[1] for k in importance}) > 2


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, "https://h.example/", "<body><p>Same text.</p></body>") for i in range(5)]
    assert set(texts(spark.createDataFrame(rows, PAGES)).values()) == {"Same text."}


def test_wrappers_named_after_their_parts_keep_the_article(spark):
    pages = {
        1: '<div class="content-sidebar-wrap"><main><p>Body one.</p></main><aside>side</aside></div>',
        2: '<div id="page" class="has-sidebar"><article><p>Body two.</p><div class=share>Share</div></article></div>',
        3: '<form action="x"><div class="has-sidebar"><p>Body three.</p></div><nav>Menu</nav></form>',
        4: '<article><p>Body four.</p></article><section class="comments"><article>Nice!</article></section><aside><article>More</article></aside>',
    }
    df = spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, h in pages.items()], PAGES)
    assert texts(df) == {1: "Body one.", 2: "Body two.", 3: "Body three.", 4: "Body four."}


def test_what_all_articles_of_a_host_repeat_goes(spark):
    rows = [(i, "http://h.example/", f"<article><p>Text {i}.</p><div class=x>Read our terms</div></article>") for i in range(12)]
    assert texts(spark.createDataFrame(rows, PAGES)) == {i: f"Text {i}." for i in range(12)}
    copies = [(i, "http://c.example/", "<article><h1>A</h1><p>Same text.</p></article>") for i in range(12)]
    assert set(texts(spark.createDataFrame(copies, PAGES)).values()) == {"A\n\nSame text."}


def test_given_pages_against_their_template(spark, small_dir):
    """The given pages hold one article element each; cut it out by hand."""
    want = {}
    for r in table(spark, small_dir, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|li|ul|div)>", inner)
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", p).replace("<b>", "").replace("</b>", "")).split()) for p in parts]
        want[r.page_id] = "\n\n".join(p for p in parts if p)
    got = op3_html_extraction(spark, small_dir).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_nulls_empty_broken_markup_and_clashing_columns(spark):
    rows = [(1, None, None), (2, "no url", ""), (None, "http://a.example", "<p>x<b>y</p> z <a href='>'>w</a> <"), (4, None, "plain &am text")]
    df = spark.createDataFrame(rows, PAGES)
    got = texts(df)
    assert got[1] == "" and got[2] == "" and got[4] == "plain &am text"
    assert got[None] == "xy\n\nz w <"
    assert extract_text(df.withColumnRenamed("page_id", "host")).columns == ["host", "url", "html", "text"]
    assert extract_text(df.limit(0)).count() == 0
    assert [b.text for b in blocks_of("<div>" * 3000 + "deep")] == ["deep"]
