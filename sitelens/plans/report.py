"""Report tables per site, their counts, and the report as rows.

The flat tables are the result at scale. As one report, every entry is a row with
its site, section and number in the section; a hot site is many rows, and no row or
task holds a whole site. A site whose scan found nothing has its own row too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sitelens.functions import urls
from sitelens.functions.sql import each_indexed, keep, struct, text
from sitelens.operators.discovery import hidden_resources
from sitelens.operators.links import parsed_pages
from sitelens.operators.locales import LANGUAGE_FIELDS, classify
from sitelens.operators.ranking import number_by_order
from sitelens.schemas import DOCUMENT_INFO, HIDDEN_INFO, LOCALE_INFO, PAGE_INFO

# Media types by document extension.
MIME_TYPES = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}

SECTIONS = ("pages", "documents", "hidden_resources", "locales")
# The row that each site has, whatever was found.
SITE = "site"


# All a report takes from the markup, read in one pass.
ENTRY_FIELDS = ("hrefs", "meta", "headings", *LANGUAGE_FIELDS)


def parsed_entries(pages: DataFrame, fields: tuple[str, ...] = ENTRY_FIELDS) -> DataFrame:
    """Raw report entries: ``page_id, site, k, url`` with links and the other ``fields``."""
    return parsed_pages(pages, "site", "k", fields=fields)


def pages_table(entries: DataFrame) -> DataFrame:
    """One row per entry, defaults where nothing was parsed. ``headers`` has no producer."""
    return entries.selectExpr(
        "site",
        "k",
        "coalesce(url, '') AS url",
        "coalesce(links, array()) AS links",
        "coalesce(meta, map()) AS meta",
        "coalesce(headings, map()) AS headings",
        "cast(map() AS map<string,string>) AS headers",
    )


def document_entries(entries: DataFrame) -> DataFrame:
    """One row per document link: ``site, k, pos, url``."""
    placed = keep(
        each_indexed("links", lambda l, i: struct(pos=i, url=l)),
        lambda l: urls.is_document(f"{l}.url"),
    )
    return entries.selectExpr("site", "k", f"explode({placed}) AS l").selectExpr(
        "site", "k", "l.pos", "l.url"
    )


def documents_table(entries: DataFrame, responses: DataFrame) -> DataFrame:
    """Document links with name, size and type; size 0 if there is no stored answer."""
    sizes = responses.groupBy("url").agg(F.max("size").alias("size"))
    mime = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in MIME_TYPES.items())
    return (
        document_entries(entries)
        .join(sizes, "url", "left")
        .selectExpr(
            "site",
            "k",
            "pos",
            "substring_index(url, '/', -1) AS name",
            "url",
            "coalesce(size, cast(0 AS bigint)) AS size",
            f"CASE lower(substring_index(url, '.', -1)) {mime} ELSE '' END AS mime",
        )
    )


def hidden_table(bases: DataFrame, words: DataFrame, responses: DataFrame) -> DataFrame:
    """Hidden resources per site: content type renamed, defaults filled in."""
    return hidden_resources(bases, words, responses).selectExpr(
        f"{urls.domain_of('base')} AS site",
        "url",
        "status",
        "coalesce(content_type, '') AS type",
        "coalesce(size, cast(0 AS bigint)) AS size",
    )


def locales_table(entries: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """``site, lang, pos, url``: URLs of each locale in sorted order, not deduplicated.

    ``entries``: ``page_id, site, url`` and the language fields.
    """
    found = classify(entries, rules, "site")
    ordered = number_by_order(found, ["site", "lang"], ["url", "page_id"], "pos")
    return ordered.select("site", "lang", "pos", "url")


def last_entry_locales(entries: DataFrame) -> DataFrame:
    """Locale lists of the last raw entry of each site, sorted, not deduplicated.

    ``entries``: ``site, seq, locales MAP<STRING, ARRAY<STRING>>``.
    """
    return (
        entries.groupBy("site")
        .agg(F.max_by("locales", "seq").alias("locales"))
        .selectExpr("site", "explode(locales) AS (lang, urls)")
        .selectExpr("site", "lang", "sort_array(urls) AS urls")
    )


def counts(
    sites: DataFrame, pages: DataFrame, documents: DataFrame, hidden: DataFrame, locales: DataFrame
) -> DataFrame:
    """Entries per site and section, in one map-side combined aggregation."""
    sections = {"pages": pages, "documents": documents, "hidden": hidden, "locale_urls": locales}
    tagged = [df.selectExpr("site", f"'{name}' AS section") for name, df in sections.items()]
    tagged.append(sites.selectExpr("site", "'site' AS section"))
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy("site").agg(
        *(F.expr(f"count_if(section = '{name}')").alias(f"n_{name}") for name in sections)
    )


def report_rows(
    sites: DataFrame, pages: DataFrame, documents: DataFrame, hidden: DataFrame, locales: DataFrame
) -> DataFrame:
    """``site, section, seq`` and one of ``page, document, hidden, locale`` per entry.

    ``seq`` counts from 1 in the order of the section; URLs of a locale are counted
    inside their locale. Each of the ``sites`` has a row of section ``SITE``, seq 0.
    """
    placed_documents = number_by_order(documents, ["site"], ["k", "pos"], "seq")
    placed_hidden = number_by_order(hidden, ["site"], ["url", "status"], "seq")
    rows = [
        sites.selectExpr("site", f"'{SITE}' AS section", "cast(0 AS bigint) AS seq"),
        pages.selectExpr(
            "site", "'pages' AS section", "cast(k AS bigint) AS seq",
            f"cast(struct(url, links, meta, headings, headers) AS {PAGE_INFO}) AS page",
        ),
        placed_documents.selectExpr(
            "site", "'documents' AS section", "seq",
            f"cast(struct(name, url, size, mime) AS {DOCUMENT_INFO}) AS document",
        ),
        placed_hidden.selectExpr(
            "site", "'hidden_resources' AS section", "seq",
            f"cast(struct(url, status, type, size) AS {HIDDEN_INFO}) AS hidden",
        ),
        locales.selectExpr(
            "site", "'locales' AS section", "cast(pos AS bigint) AS seq",
            f"cast(struct(lang, url) AS {LOCALE_INFO}) AS locale",
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
