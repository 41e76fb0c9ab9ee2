"""Whole-site report documents: one JSON document per site, of any size.

No row and no task holds a site. A document is a sequence of pieces: its brackets and
section headings are rows of their own, between them is a row for every entry. Pieces
are range-partitioned by site and place and written in that order to a folder per site;
the files of a folder, one after the other, are the site's document. A small site is one
file, a hot one spans as many as its pieces take.

Documents are read by pieces too. In either layout the end of an entry shows in the text
itself, so a file is cut at the ends of its entries wherever a split begins, and what an
entry is shows in its keys; only the few headings of the locales are looked up by place.

Layouts: ``pretty`` is the one of report files, an indent of two spaces; the compact one
has a line for every piece. Documents by other writers are read if they are laid out as
the pretty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelens.functions.json_text import array_text, map_text, number, object_text, quoted
from sitelens.functions.sql import keep, raw, text
from sitelens.operators.ranking import number_by_order
from sitelens.schemas import DOCUMENT_INFO, HIDDEN_INFO, LOCALE_INFO, PAGE_INFO, REPORT_ROW
from sitelens.session import materialize

#: Sections in the order of a document, with the column of their entries.
ENTRY_SECTIONS = {"pages": "page", "documents": "document", "hidden_resources": "hidden"}
_LOCALES = "locales"
PLACE = ("section_no", "lang", "part", "seq")
_OPEN, _ENTRY, _CLOSE = range(3)


def _entry_text(section: str, pretty: bool) -> str:
    column = ENTRY_SECTIONS[section]
    if not pretty:
        return f"to_json({column}, map('ignoreNullFields', 'false'))"
    fields = {
        "pages": {
            "url": quoted("page.url"),
            "links": array_text("page.links", 6),
            "meta": map_text("page.meta", 6),
            "headings": map_text("page.headings", 6, lambda h: array_text(h, 8)),
            "headers": map_text("page.headers", 6),
        },
        "documents": {
            "name": quoted("document.name"),
            "url": quoted("document.url"),
            "size": number("document.size"),
            "mime": quoted("document.mime"),
        },
        "hidden_resources": {
            "url": quoted("hidden.url"),
            "status": number("hidden.status"),
            "type": quoted("hidden.type"),
            "size": number("hidden.size"),
        },
    }[section]
    return f"concat('    ', {object_text(fields, 4)})"


def pieces(rows: DataFrame, pretty: bool = True) -> DataFrame:
    """``site, section_no, lang, part, seq, text`` of report rows: ordered by these, documents.

    ``rows`` has ``seq`` 1, 2, 3 ... in each section, in a locale for ``locales``.
    """
    keyed = rows.withColumn("lang", F.coalesce("locale.lang", F.lit("")))
    # A row per site and section, and one per locale: where sections end.
    ends = materialize(
        keyed.groupBy("site", "section", "lang").agg(F.max("seq").alias("last")), "section-ends"
    )
    sites = ends.select("site").distinct()
    pad, gap = ("  ", ": ") if pretty else ("", ":")

    def key(indent: int, name: str) -> str:
        return f"concat('{pad * indent}', {name}, '{gap}')"

    def piece(df: DataFrame, number_: int, lang: str, part: int, seq: str, value: str) -> DataFrame:
        return df.selectExpr(
            "site", f"{number_} AS section_no", f"{lang} AS lang", f"{part} AS part",
            f"cast({seq} AS bigint) AS seq", f"{value} AS text",
        )

    parts = [piece(sites, 0, "''", _OPEN, "0", "'{'")]
    for at, section in enumerate(ENTRY_SECTIONS, 1):
        mine = ends.filter(F.col("section") == section).select("site", "last")
        heading = key(1, f"'\"{section}\"'")
        opened = sites.join(mine, "site", "left")
        parts.append(piece(opened, at, "''", _OPEN, "0", f"concat({heading}, if(last IS NULL, '[],', '['))"))
        parts.append(piece(mine, at, "''", _CLOSE, "0", f"'{pad}],'"))
        entries = keyed.filter(F.col("section") == section).join(mine, "site")
        rendered = f"concat({_entry_text(section, pretty)}, if(seq < last, ',', ''))"
        parts.append(piece(entries, at, "''", _ENTRY, "seq", rendered))
    at = len(ENTRY_SECTIONS) + 1
    locales = ends.filter(F.col("section") == _LOCALES).select("site", "lang", "last")
    final = locales.groupBy("site").agg(F.max("lang").alias("last_lang"))
    opened = sites.join(final, "site", "left")
    heading = key(1, f"'\"{_LOCALES}\"'")
    # An empty object closes where it opens; no locale comes before the empty name.
    parts.append(piece(opened, at, "''", -1, "0", f"concat({heading}, if(last_lang IS NULL, '{{}}', '{{'))"))
    parts.append(piece(locales, at, "lang", _OPEN, "0", f"concat({key(2, quoted('lang'))}, '[')"))
    urls = keyed.filter(F.col("section") == _LOCALES).join(locales, ["site", "lang"])
    url = quoted("locale.url")
    parts.append(piece(urls, at, "lang", _ENTRY, "seq", f"concat('{pad * 3}', {url}, if(seq < last, ',', ''))"))
    closed = locales.join(final, "site")
    parts.append(piece(closed, at, "lang", _CLOSE, "0", f"concat('{pad * 2}]', if(lang < last_lang, ',', ''))"))
    parts.append(piece(final, at + 1, "''", _OPEN, "0", f"'{pad}}}'"))
    parts.append(piece(sites, at + 1, "''", _CLOSE, "0", "'}'"))
    return reduce(DataFrame.unionByName, parts)


def write_documents(rows: DataFrame, path: str, pretty: bool = True) -> None:
    """Write a document per site under ``path``; its folder's files in order of name are its text."""
    ordered = pieces(materialize(rows, "report-rows"), pretty)
    (
        # Not nullable and the column that is sorted by, so that the writer keeps this order.
        ordered.withColumn("site", F.expr("coalesce(site, '')"))
        .repartitionByRange("site", *PLACE)
        .sortWithinPartitions("site", *PLACE)
        .select("site", "text")
        .write.partitionBy("site")
        .text(path)
    )


_STRING = r'"(?:[^"\\]|\\.)*+"'
_SPACES = {True: ("    ", "      "), False: ("", "")}


def read_documents(spark: SparkSession, path: str, pretty: bool = True) -> DataFrame:
    """Report rows of the documents under ``path``: ``site, section, seq`` and the entry.

    As :func:`sitelens.plans.report.report_rows` gives them, a row per site included. An
    entry's section shows in its keys: ``mime`` makes a document, ``status`` a hidden
    resource, anything else a page.
    """
    entries = number_by_order(_entries(spark, path, pretty), ["site", "section"], ["file", "block", "id"], "seq")
    urls = number_by_order(_locale_urls(spark, path, pretty), ["site", "lang"], ["file", "block", "id"], "seq")
    kinds = {"page": PAGE_INFO, "document": DOCUMENT_INFO, "hidden": HIDDEN_INFO}
    names = {v: k for k, v in ENTRY_SECTIONS.items()}
    columns = [
        f"if(section = '{names[c]}', from_json(entry, {text(t)}), NULL) AS {c}" for c, t in kinds.items()
    ]
    sites = spark.read.schema("value STRING, site STRING").text(path).select("site").distinct()
    found = [
        sites.selectExpr("site", "'site' AS section", "cast(0 AS bigint) AS seq"),
        entries.selectExpr("site", "section", "seq", *columns),
        urls.selectExpr(
            "site", f"'{_LOCALES}' AS section", "seq", f"cast(struct(lang, url) AS {LOCALE_INFO}) AS locale"
        ),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    order = [f.split()[0] for f in ("site", "section", "seq", "page", "document", "hidden", "locale")]
    return rows.select(*order).to(spark.createDataFrame([], REPORT_ROW).schema)


def _texts(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Parts of the files between separators, with their place."""
    found = spark.read.schema("value STRING, site STRING").option("lineSep", separator).text(path)
    return found.selectExpr(
        "site",
        "value",
        "_metadata.file_path AS file",
        "_metadata.file_block_start AS block",
        "monotonically_increasing_id() AS id",
    )


def _entries(spark: SparkSession, path: str, pretty: bool) -> DataFrame:
    if pretty:
        # Only the end of an entry is a line of four spaces and a brace.
        found = _texts(spark, path, "\n    }").withColumn(
            "body", F.regexp_extract("value", r"(?s)(?:\A|\n)    \{(.*)\z", 1)
        )
    else:
        found = _texts(spark, path, "\n").withColumn("body", F.regexp_extract("value", r"(?s)^\{(.+)\},?\z", 1))
    keyed = found.filter("body <> ''").selectExpr("*", "concat('{', body, '}') AS entry").selectExpr(
        "*", "json_object_keys(entry) AS keys"
    )
    section = """CASE WHEN array_contains(keys, 'mime') THEN 'documents'
                      WHEN array_contains(keys, 'status') THEN 'hidden_resources' ELSE 'pages' END"""
    return keyed.selectExpr("site", f"{section} AS section", "file", "block", "id", "entry")


def _locale_urls(spark: SparkSession, path: str, pretty: bool) -> DataFrame:
    """``site, lang, url`` and the place of the locale URLs: lines that are a string alone.

    They belong to the last heading before them. A document has a heading per locale.
    """
    four, six = _SPACES[pretty]
    heading, alone = rf"^{four}({_STRING}): ?\[\z", rf"^{six}({_STRING}),?\z"
    lines = materialize(
        _texts(spark, path, "\n")
        .selectExpr(
            "site", "file", "block", "id",
            f"regexp_extract(value, {raw(heading)}, 1) AS heading", f"regexp_extract(value, {raw(alone)}, 1) AS alone",
        )
        .filter("heading <> '' OR alone <> ''"),
        "locale-lines",
    )
    value = "from_json(concat('[', {0}, ']'), 'array<string>')[0]"
    headings = (
        lines.filter("heading <> ''")
        .selectExpr("site", f"struct(file, block, id, {value.format('heading')} AS lang) AS h")
        .groupBy("site")
        .agg(F.sort_array(F.collect_list("h")).alias("headings"))
    )
    before = keep("headings", lambda h: f"struct({h}.file, {h}.block, {h}.id) < struct(file, block, id)")
    return (
        lines.filter("alone <> ''")
        .join(headings, "site")
        .selectExpr(
            "site", f"element_at({before}, -1).lang AS lang", f"{value.format('alone')} AS url", "file", "block", "id"
        )
    )
