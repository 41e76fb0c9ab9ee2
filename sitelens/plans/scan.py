"""A whole scan of many sites: crawl, then report on the pages that were reached."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.functions.urls import site_root_of
from sitelens.operators.crawl import crawl_pages
from sitelens.operators.ranking import number_by_order
from sitelens.plans import report
from sitelens.session import materialize


def scanned_pages(requests: DataFrame, snapshot: DataFrame, robots: DataFrame) -> DataFrame:
    """Reached pages with their markup: ``page_id, site, k, url, html``.

    ``k`` numbers the pages of a site in the order of the walk; ``url`` is the
    canonical one.
    """
    reached = number_by_order(
        crawl_pages(requests, snapshot, robots), ["site"], ["depth", "rank"], "k"
    )
    return snapshot.select("page_id", "html").join(
        reached.select("page_id", "site", "k", "url"), "page_id"
    )


def scan(
    requests: DataFrame,
    snapshot: DataFrame,
    robots: DataFrame,
    words: DataFrame,
    responses: DataFrame,
    locale_rules: dict[str, dict],
) -> dict[str, DataFrame]:
    """The four flat report tables of each requested site.

    Hand them to ``report.counts`` or ``report.report_rows``. Reached pages are
    parsed once and read back slim.
    """
    pages = scanned_pages(requests, snapshot, robots)
    entries = materialize(report.parsed_entries(pages), "entries")
    bases = requests.selectExpr(f"{site_root_of('base_url')} AS base")
    return {
        "pages": report.pages_table(entries),
        "documents": report.documents_table(entries, responses),
        "hidden": report.hidden_table(bases, words, responses),
        "locales": report.locales_table(entries, locale_rules),
    }
