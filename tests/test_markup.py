"""Fields of plain markup, read natively, against the tokenizer."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sitelens.functions.html import FIELDS, _field, _parse
from sitelens.functions.markup import native_fields, with_fields

from test_html import CASES, PIECES

MORE = [
    "<h1>", "</h1>", "<h2 class=x>", "</H2>", "<H1>One</h1>", "<h3>a <b>c</b> d</h3>", "<h1>x<br>y</h1>", "<h1> </h1>",
    "<h2>a<i>b<u>c</u></i></h2>", "<div>", "</div>", "<title>", "</title>", "<title>T &copy; é</title>", "<title/>",
    "<title>a<b>c</title>", "<meta name=d content=1>", "<meta property='og' content=\"x y\">", "<meta name='' property=p content=''>",
    "<meta name=d content=2>", "<meta content=z name>", "<meta charset=utf-8>", "<meta name=e content='a&amp;b'>", "<metadata name=q content=r>",
    "<html lang=en>", "<html>", "<HTML LANG='fr' lang=de>", "<html lang>", "<link hreflang=de href=/de>", "<link hreflang=''>", "<link hreflang>",
    "<noscript>", "</noscript>", "<rt>", "<template>x</template>", "&copy;", "&nbsp;", "&amp;lt;", "&lt;p&gt;", "&eacute", "&bogus;", "&#65;", "& ",
    "\x01", "<!>", " ", "\x1c", "<b>bold</b>", "</b>", "<img alt='<h1>'>", "<p title=\"a&b\">", "<br>", "<textarea><h1>", "</br>",
]


def tokenized(markup):
    page = _parse(markup, True)
    values = {f: _field(page, f) for f in FIELDS}
    return values | {f: dict(values[f]) for f in ("meta", "headings")}


def agree(spark, texts):
    """How many of the texts are read natively; all of these must be read as the tokenizer does."""
    df = spark.createDataFrame([(t,) for t in texts], "html STRING").coalesce(1)
    native = 0
    for field in ((f,) for f in FIELDS) if len(texts) < 300 else (FIELDS,):
        for row in df.select("html", F.expr(native_fields("html", field)).alias("page")).collect():
            if row.page is not None:
                native += 1
                want = tokenized(row.html)
                for name in field:
                    assert row.page[name] == want[name], (name, row.html)
                    if name in ("meta", "headings"):
                        assert list(row.page[name]) == list(want[name]), (name, row.html)
    return native


def test_single_pieces(spark):
    assert agree(spark, [c[0] for c in CASES] + MORE + PIECES) > 300


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(MORE + PIECES), max_size=6), min_size=320, max_size=320))
def test_random_markup(spark, pages):
    assert agree(spark, ["".join(p) for p in pages])


@pytest.mark.parametrize("fields", [("text",), ("hrefs", "title"), FIELDS])
def test_all_pages_are_read(spark, fields):
    texts = [c[0] for c in CASES] + MORE + PIECES
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i INT, html STRING")
    rows = {r.i: r.page for r in with_fields(df, fields).collect()}
    assert len(rows) == len(texts) + 1
    assert rows[-1] is None or all(v is None for v in rows[-1])
    for i, t in enumerate(texts):
        assert rows[i].asDict() == {f: tokenized(t)[f] for f in fields}, t


def test_ordinary_pages_stay_native(spark):
    markup = (
        "<!DOCTYPE html><html lang='en'><head><meta name=description content='x'><title>A &amp; B</title>"
        "<script>if (a<b) x='</p>'</script></head><body><h1>One <a href=/x>two</a></h1><p>1 < 2 &copy; &middot;</p></body></html>"
    )
    df = spark.createDataFrame([(markup * 500,)], "html STRING")
    page = df.select(F.expr(native_fields("html", ("hrefs", "title", "text", "headings", "html_lang"))).alias("p")).head().p
    assert page.title == "A & B" and page.headings == {"h1": ["One two"] * 500} and page.html_lang == "en"
    assert page.text == " ".join(["A & B One two 1 < 2 © ·"] * 500)
