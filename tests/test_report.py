"""Report tables, nested parts, JSON sink and source."""

import json

import pytest

from sitelens.plans import report
from sitelens.sources import reports


@pytest.fixture()
def tables(spark):
    """One site with many entries, one with a single page."""
    pages = [("big", k, f"http://big/{k}", [f"l{k}"], {"m": "é"}, {"h1": ["t"]}, {}) for k in range(1, 26)]
    pages.append(("small", 1, "http://small", [], {}, {}, {}))
    documents = [("big", k, p, "d.pdf", f"http://big/{k}-{p}.pdf", 0, "application/pdf") for k in range(1, 26) for p in (0, 1)]
    hidden = [("big", f"http://big/h{i:02}", None if i == 3 else 200, "text/html", i) for i in range(12)]
    locales = [("big", lang, i + 1, f"u{i:02}") for lang in ("de", "fr") for i in range(23)]
    return {
        "pages": spark.createDataFrame(
            pages,
            "site STRING, k BIGINT, url STRING, links ARRAY<STRING>, meta MAP<STRING,STRING>,"
            " headings MAP<STRING,ARRAY<STRING>>, headers MAP<STRING,STRING>",
        ),
        "documents": spark.createDataFrame(
            documents, "site STRING, k BIGINT, pos INT, name STRING, url STRING, size BIGINT, mime STRING"
        ),
        "hidden": spark.createDataFrame(
            hidden, "site STRING, url STRING, status INT, type STRING, size BIGINT"
        ),
        "locales": spark.createDataFrame(locales, "site STRING, lang STRING, pos BIGINT, url STRING"),
    }


@pytest.fixture()
def rows(spark, tables):
    sites = spark.createDataFrame([("big",), ("small",), ("empty",)], "site STRING")
    return report.report_rows(sites, **tables)


def section(rows, site, name):
    found = [r for r in reports.as_json(rows).collect() if (r.site, r.section) == (site, name)]
    return [(r.seq, json.loads(r.json)) for r in sorted(found, key=lambda r: (r.seq, r.json))]


def test_rows_make_the_whole_report(rows):
    pages = section(rows, "big", "pages")
    assert [(n, p["url"]) for n, p in pages] == [(k, f"http://big/{k}") for k in range(1, 26)]
    assert pages[0][1] == {
        "url": "http://big/1", "links": ["l1"], "meta": {"m": "é"}, "headings": {"h1": ["t"]}, "headers": {},
    }
    documents = section(rows, "big", "documents")
    assert [n for n, _ in documents] == list(range(1, 51))
    assert [d["url"] for _, d in documents] == [f"http://big/{k}-{p}.pdf" for k in range(1, 26) for p in (0, 1)]
    hidden = section(rows, "big", "hidden_resources")
    assert [h["url"] for _, h in hidden] == [f"http://big/h{i:02}" for i in range(12)]
    assert hidden[3][1]["status"] is None and "status" in hidden[3][1]
    locales = section(rows, "big", "locales")
    assert [(n, x["url"]) for n, x in locales if x["lang"] == "de"] == [(i + 1, f"u{i:02}") for i in range(23)]
    assert [p["url"] for _, p in section(rows, "small", "pages")] == ["http://small"]


def test_an_empty_scan_has_a_report(rows):
    assert section(rows, "empty", report.SITE) == [(0, {})]
    assert [r.section for r in rows.collect() if r.site == "empty"] == [report.SITE]


def test_round_trip(spark, rows, tmp_path):
    reports.write_reports(rows, str(tmp_path / "r"))
    again = reports.read_reports(spark, str(tmp_path / "r"))
    mine, theirs = (
        sorted((r.site, r.section, r.seq, r.json) for r in reports.as_json(df).collect()) for df in (rows, again)
    )
    assert mine == theirs and any("é" in r[3] for r in mine)


def test_pretty(rows):
    text = reports.as_json(rows, pretty=True).filter("site = 'small' AND section = 'pages'").head().json
    assert "\n  " in text and json.loads(text)["url"] == "http://small"


def test_counts(spark, tables):
    sites = spark.createDataFrame([("big",), ("small",), ("empty",)], "site STRING")
    rows = {r.site: tuple(r)[1:] for r in report.counts(sites, **tables).collect()}
    assert rows == {"big": (25, 50, 12, 46), "small": (1, 0, 0, 0), "empty": (0, 0, 0, 0)}


def test_locales_of_the_last_entry(spark):
    rows = [("s", 1, {"de": ["x"]}), ("s", 2, {"fr": ["b", "a", "b"], "de": []})]
    df = spark.createDataFrame(rows, "site STRING, seq INT, locales MAP<STRING, ARRAY<STRING>>")
    got = {r.lang: r.urls for r in report.last_entry_locales(df).collect()}
    assert got == {"fr": ["a", "b", "b"], "de": []}


def test_document_defaults(spark):
    entries = spark.createDataFrame(
        [("s", 1, ["http://s/a.PDF", "http://s/b.docx", "http://s/c"])], "site STRING, k BIGINT, links ARRAY<STRING>"
    )
    sizes = spark.createDataFrame([("http://s/a.PDF", 7)], "url STRING, size BIGINT")
    got = sorted((r.name, r.size, r.mime) for r in report.documents_table(entries, sizes).collect())
    assert got == [("a.PDF", 7, "application/pdf"), ("b.docx", 0, report.MIME_TYPES["docx"])]
