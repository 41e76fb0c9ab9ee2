"""The tokenizer pass, and native links against it."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sitelens.functions.html import _parse, plain_hrefs, raw_hrefs, read_html, with_hrefs

CASES = [
    # markup, hrefs, title, text
    ("", [], "", ""),
    ("<title> A &amp; B </title>x", [], "A & B", "A & B x"),
    ("<a href=' /x '>one</a> <A HREF=/y>two</A>", [" /x ", "/y"], "", "one two"),
    ("<a>no</a><a href>empty</a><a href=''>e</a>", ["", ""], "", "no empty e"),
    ("<a href=1 href=2>dup</a>", ["2"], "", "dup"),
    ("<!-- <a href=/hidden> --><a href=/seen>", ["/seen"], "", ""),
    ("<script>var a='<a href=\"/js\">';</script>t", [], "", "t"),
    ("<style>p{}</style><noscript>n<a href=/n></noscript>v", ["/n"], "", "v"),
    ("<template><p>t</p></template>after", [], "", "after"),
    ("a<br>b<p> c  d </p>", [], "", "a b c  d"),
    ("caf&eacute; &#233; &#x41; &nope; &amp;lt;", [], "", "café é A &nope &lt;"),
    ("<a href='?a=1&amp;b=2&copy=3'>x</a>", ["?a=1&b=2©=3"], "", "x"),
    ("<title>one</title><title>two</title>", [], "one", "one two"),
    ("<!DOCTYPE html><?pi x?>t", [], "", "t"),
    ("<div><noscript>gone</div>back", [], "", "back"),
    ("1 < 2 <b>x</b>", [], "", "1 < 2 x"),
    ("&#147;q&#148;", [], "", "“q”"),
]


@pytest.mark.parametrize("markup, hrefs, title, text", CASES)
def test_fields(markup, hrefs, title, text):
    page = _parse(markup, True)
    assert page.hrefs == hrefs
    assert "".join(page.title or ()) == title
    assert " ".join(page.words) == text
    assert _parse(markup, False).hrefs == hrefs


def test_struct_of_fields(spark):
    markup = (
        '<html lang="fr"><head><meta name=d content=1><meta property="og:t" content="x">'
        '<meta name=d content=2><link rel=alternate hreflang=de href=/de></head>'
        "<h1>One <b>bold</b></h1><h2>Two</h2><h1>Three</h1><a href=/x>t</a></html>"
    )
    df = spark.createDataFrame([(markup,), (None,)], "html STRING")
    whole, missing = df.select(read_html(F.col("html")).alias("p")).collect()
    assert whole.p.meta == {"d": "2", "og:t": "x"}
    assert whole.p.headings == {"h1": ["One bold", "Three"], "h2": ["Two"]}
    assert whole.p.html_lang == "fr"
    assert whole.p.hreflangs == ["de"]
    assert missing.p.hrefs is None and missing.p.text is None


def test_raw_hrefs(spark):
    markup = "<link HREF='a'><!-- href=\"b\" --><x href=\"\"><y href='c\"><z href=\"d\ne\">"
    df = spark.createDataFrame([(markup,)], "html STRING")
    assert df.select(raw_hrefs("html")).head()[0] == ["a", "b", "c"]


PIECES = [
    "<a href='/x'>", '<a href="/y?a=1&amp;b=2">', "<a href=/z/>", "<a href = '/sp' >", "</a>",
    "<a\nhref='/nl'>", "<A HREF=/up>", "<a title=' href=/no ' href='/yes'>", "<a data-href=/no>",
    "<a href>", "<a href=''>", "<a href=\"\">", "<a href=1 href=2>", "<a href='/c&copy=1'>",
    "<a href='/c&copy;'>", "<a href='/b&b=2'>", "<a href='/n&#65;'>", "<a href='/q' / >",
    "<a/href=/slash>", "<abbr href=/abbr>", "<a href='/u'title=x>", "<a href='x>y'>",
    "<!-- <a href=/c> -->", "<!-- -- -->", "<!-->", "<!--", "-->", "<!DOCTYPE html>", "<?php ?>",
    "<script>", "</script>", "<script src=x>", "<script/>", "<style>", "</style>", "</ script>",
    "var a='</p>';", "<p>", "</p>", "<br/>", "text", " ", "\n", "<", ">", "&", "'", '"', "< a",
    "<a", "<a href='", "</", "<!", "<![CDATA[x]]>", "<![if x]>", "é", "\xa0", "<é>", "=",
    "<a href=é>", "<a href=a\xa0b>", "<td nowrap>", "<a href=x\x0bhref=y>", "<img alt='a>b'>",
]


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=7), min_size=60, max_size=60))
def test_native_links_agree_with_the_tokenizer(spark, pages):
    texts = ["".join(p) for p in pages] + PIECES
    df = spark.createDataFrame([(t,) for t in texts], "html STRING").coalesce(1)
    native = df.select("html", F.expr(plain_hrefs("html")).alias("hrefs")).collect()
    for row in native:
        if row.hrefs is not None:
            assert row.hrefs == _parse(row.html, False).hrefs, row.html


def test_all_pages_get_links(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PIECES)] + [(-1, None)], "i INT, html STRING")
    rows = with_hrefs(df.selectExpr("*", "html AS source")).collect()
    assert len(rows) == len(PIECES) + 1
    for row in rows:
        assert row.hrefs == (None if row.source is None else _parse(row.source, False).hrefs)


def test_plain_markup_stays_native(spark):
    markup = (
        "<!DOCTYPE html><html><head><script>if (a<b) x='</p>'</script></head>"
        "<body class=c><!-- note --><a id=1 href='/a?x=1&amp;y=2&z=3'>a</a> 1 < 2</body></html>"
    )
    df = spark.createDataFrame([(markup * 2000,)], "html STRING")
    assert df.select(F.expr(plain_hrefs("html"))).head()[0] == ["/a?x=1&y=2&z=3"] * 2000


def test_titles_count_anywhere_and_ruby_readings_do_not(spark):
    pages = ["<noscript><title>x</title></noscript>", "<p>K<ruby>a<rp>(</rp><rt>kan</rt><rp>)</rp></ruby> z</p>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id INT, html STRING")
    rows = df.withColumn("page", read_html(df["html"], ("title", "text"))).orderBy("page_id").collect()
    assert rows[0].page.title == "x" and rows[1].page.text == "K a z"
