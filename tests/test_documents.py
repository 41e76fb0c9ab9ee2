"""Whole-site documents: their text, their layout over files, and reading them back."""

import json
from pathlib import Path
from urllib.parse import unquote

import pytest

from sitelens.plans import report
from sitelens.schemas import REPORT_ROW
from sitelens.sources import documents

PAGE = ("url", "links", "meta", "headings", "headers")


def page(url, links=(), meta=None, headings=None, headers=None):
    return (url, list(links), meta or {}, headings or {}, headers or {})


@pytest.fixture()
def rows(spark):
    """A hot site with many entries, an odd one, an empty one."""
    found = [(s, "site", 0, None, None, None, None) for s in ("http://hot/x", "odd", "empty", "1")]
    for k in range(1, 400):
        found.append(("http://hot/x", "pages", k, page(f"http://hot/{k}", [f"l{k}"] * (k % 4), {"m": "é"}, {"h1": ["a", "b"], "h2": []}), None, None, None))
        found.append(("http://hot/x", "documents", k, None, (f"{k}.pdf", f"http://hot/{k}.pdf", k, "application/pdf"), None, None))
        for lang in ("de", "fr"):
            found.append(("http://hot/x", "locales", k, None, None, None, (lang, f"http://hot/{lang}/{k}")))
    text = 'quote " back \\ line \n    }\n    {\n      "x", tab \t   </é\U0001f600 {[,]}'
    found += [
        ("odd", "pages", 1, page(text, [text, "", None], {text: text, "": ""}, {text: [text]}, {"a": "b"}), None, None, None),
        ("odd", "hidden_resources", 1, None, None, (text, None, None, 0), None),
        ("odd", "hidden_resources", 2, None, None, ("u", 204, "", 2**40), None),
        ("odd", "locales", 1, None, None, None, (text, text)),
        ("odd", "locales", 1, None, None, None, ("", "u")),
        ("1", "documents", 1, None, ("n", "u", 0, ""), None, None),
    ]
    return spark.createDataFrame(found, REPORT_ROW)


def expected(rows):
    """The documents as plain objects."""
    sites = {r.site: {"pages": [], "documents": [], "hidden_resources": [], "locales": {}} for r in rows}
    for r in sorted(rows, key=lambda r: r.seq):
        entry = r.page or r.document or r.hidden
        if r.section == "locales":
            sites[r.site]["locales"].setdefault(r.locale.lang, []).append(r.locale.url)
        elif r.section != report.SITE:
            sites[r.site][r.section].append(entry.asDict(recursive=True))
    for s in sites.values():
        s["locales"] = dict(sorted(s["locales"].items()))
    return sites


def stored(path):
    """Text of each site's document: the files of its folder, one after the other."""
    folders = [p for p in Path(path).iterdir() if p.is_dir()]
    return {
        unquote(f.name.removeprefix("site=")): "".join(p.read_text() for p in sorted(f.glob("part-*"))) for f in folders
    }


@pytest.mark.parametrize("partitions", [1, 16])
def test_pretty_documents_have_the_layout_of_report_files(spark, rows, tmp_path, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        documents.write_documents(rows, str(tmp_path / "d"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = expected(rows.collect())
    got = stored(tmp_path / "d")
    assert {s: json.loads(t) for s, t in got.items()} == want
    for site, document in want.items():
        assert got[site] == json.dumps(document, ensure_ascii=False, indent=2) + "\n", site
    files = list((tmp_path / "d").glob("site=http*/part-*"))
    # The hot site spans tasks: nobody holds it whole.
    assert len(files) == 1 if partitions == 1 else len(files) > 8


def test_compact_documents(rows, tmp_path):
    documents.write_documents(rows, str(tmp_path / "d"), pretty=False)
    got = stored(tmp_path / "d")
    assert {s: json.loads(t) for s, t in got.items()} == expected(rows.collect())
    assert "  " not in got["http://hot/x"] and len(got["empty"].splitlines()) == 6


def values(df):
    return sorted((json.dumps(r.asDict(recursive=True), ensure_ascii=False, sort_keys=True) for r in df.collect()))


@pytest.mark.parametrize("pretty", [True, False])
@pytest.mark.parametrize("split", ["128m", "2k"])
def test_documents_are_read_by_pieces(spark, rows, tmp_path, pretty, split):
    documents.write_documents(rows, str(tmp_path / "d"), pretty)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        if split == "2k":
            assert spark.read.text(str(tmp_path / "d")).rdd.getNumPartitions() > 20
        assert values(documents.read_documents(spark, str(tmp_path / "d"), pretty)) == values(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.set("spark.sql.files.openCostInBytes", "4m")


def test_documents_of_other_writers(spark, rows, tmp_path):
    """Whole files with the plain layout, one per site."""
    for site, document in expected(rows.collect()).items():
        folder = tmp_path / "d" / f"site={site.replace(':', '%3A').replace('/', '%2F')}"
        folder.mkdir(parents=True)
        (folder / "report.json").write_text(json.dumps(document, ensure_ascii=False, indent=2))
    assert values(documents.read_documents(spark, str(tmp_path / "d"))) == values(rows)


def test_no_sites(spark, tmp_path):
    none = spark.createDataFrame([], REPORT_ROW)
    assert documents.pieces(none).count() == 0
