"""Link extraction and link tables.

Links of one page are handled as an array on the page's own row: resolving,
filtering and in-page dedup need no shuffle, and a page's array is bounded by
its text. Rows are exploded only where a result has one row per link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.functions import urls
from sitelens.functions.html import raw_hrefs, with_hrefs
from sitelens.functions.markup import with_fields
from sitelens.functions.sql import each, each_indexed, keep, let, struct
from sitelens.functions.text import strip


def followed(hrefs: str) -> str:
    """Structs of document position and stripped href, unfollowed schemes dropped."""
    placed = each_indexed(hrefs, lambda h, i: struct(pos=i, href=strip(h)))
    return keep(placed, lambda l: urls.is_followed(f"{l}.href"))


def resolved(placed: str, base: str) -> str:
    """Add ``link`` (absolute URL) and ``parts`` to structs of ``pos`` and ``href``.

    ``base`` names a part struct, so it is split once per page. Links that are
    just a path from the root, the most common ones, skip the general rules.
    """

    def link_struct(l: str, link: str, parts: str) -> str:
        return struct(pos=f"{l}.pos", href=f"{l}.href", link=link, parts=parts)

    def below_root(l: str) -> str:
        link = f"concat({base}.scheme, '://', {base}.authority, {l}.href)"
        parts = struct(
            scheme=f"{base}.scheme",
            authority=f"{base}.authority",
            path=f"{l}.href",
            params="''",
            query="''",
            fragment="''",
        )
        return link_struct(l, link, parts)

    def by_rule(l: str) -> str:
        def given(ref: str, alone: str) -> str:
            return let(
                urls.resolve(base, ref, alone),
                lambda p: link_struct(l, f"if({alone}, {l}.href, {urls.assemble(p)})", p),
            )

        return let(
            urls.parse(f"{l}.href"),
            lambda ref: let(urls.stands_alone(base, ref), lambda alone: given(ref, alone)),
        )

    on_web = f"{base}.scheme IN ('http', 'https') AND {base}.authority <> ''"
    return each(
        placed,
        lambda l: (
            f"if({on_web} AND {urls.is_rooted_path(f'{l}.href')}, {below_root(l)}, {by_rule(l)})"
        ),
    )


def resolve_all(hrefs: str, base_url: str) -> str:
    """Resolve every href of an array against ``base_url``."""
    placed = each_indexed(hrefs, lambda h, i: struct(pos=i, href=h))
    return let(placed, lambda p: let(urls.parse(base_url), lambda b: resolved(p, b)))


def resolved_hrefs(hrefs: str, base_url: str) -> str:
    """Followed hrefs of a page, resolved against its URL."""
    return let(
        followed(hrefs), lambda p: let(urls.parse(base_url), lambda b: resolved(p, b))
    )


def internal(hrefs: str, base_url: str) -> str:
    """Followed links that stay on the page's authority, in order, duplicates kept."""
    return let(
        followed(hrefs),
        lambda p: let(
            urls.parse(base_url),
            lambda b: keep(
                resolved(p, b), lambda l: urls.in_domain(f"{l}.parts", f"{b}.authority")
            ),
        ),
    )


def distinct_parsed(hrefs: str, base_url: str) -> str:
    """Parsed-page links: canonical, external ones too, first occurrence kept."""
    forms = each(resolved_hrefs(hrefs, base_url), lambda l: urls.parsed_form(f"{l}.parts"))
    return f"array_distinct({forms})"


def crawl_base(pages: DataFrame, *keep_columns: str) -> DataFrame:
    """Pages with ``norm``, the canonical URL links resolve against, and ``hrefs``."""
    return with_hrefs(pages.select("page_id", *keep_columns, "url", "html")).selectExpr(
        "page_id", *keep_columns, f"{urls.crawl_form_of('url')} AS norm", "hrefs"
    )


def resolved_links(pages: DataFrame) -> DataFrame:
    """Every followed href with its absolute URL."""
    return (
        crawl_base(pages)
        .selectExpr("page_id", f"explode({resolved_hrefs('hrefs', 'norm')}) AS l")
        .selectExpr("page_id", "l.pos", "l.href", "l.link AS absolute")
    )


def internal_links(pages: DataFrame, *keep_columns: str) -> DataFrame:
    """Same-authority links of each page; ``pos`` is the place among all hrefs."""
    return (
        crawl_base(pages, *keep_columns)
        .selectExpr("page_id", *keep_columns, f"explode({internal('hrefs', 'norm')}) AS l")
        .selectExpr("page_id", *keep_columns, "l.pos", "l.link")
    )


def parsed_pages(pages: DataFrame, *keep_columns: str, fields: tuple[str, ...]) -> DataFrame:
    """Pages with the parsed ``fields``; ``hrefs`` becomes ``links``."""
    if fields == ("hrefs",):
        linked = with_hrefs(pages)
        return linked.selectExpr(
            "page_id", "url", *keep_columns, f"{distinct_parsed('hrefs', 'url')} AS links"
        )
    parsed = with_fields(pages.select("page_id", "url", *keep_columns, "html"), fields)
    plain = [f"page.{f} AS {f}" for f in fields if f != "hrefs"]
    links = [f"{distinct_parsed('page.hrefs', 'url')} AS links"] if "hrefs" in fields else []
    return parsed.selectExpr("page_id", "url", *keep_columns, *plain, *links)


def same_host_links(parsed: DataFrame) -> DataFrame:
    """Links of parsed pages on the page's own authority."""
    on_host = keep(
        each_indexed("links", lambda l, i: struct(pos=i, link=l)),
        lambda l: f"{urls.domain_of(f'{l}.link')} = {urls.domain_of('url')}",
    )
    return parsed.selectExpr("page_id", f"explode({on_host}) AS l").selectExpr(
        "page_id", "l.pos", "l.link"
    )


def raw_href_rows(pages: DataFrame) -> DataFrame:
    """Quoted ``href=`` values of the raw markup, one row each."""
    return pages.select("page_id", raw_hrefs("html").alias("found")).selectExpr(
        "page_id", "posexplode(found) AS (pos, href)"
    )


def document_links(parsed: DataFrame) -> DataFrame:
    """One row per document link of each parsed page."""
    found = keep("links", urls.is_document)
    return parsed.selectExpr("url AS source_page", f"explode({found}) AS url").selectExpr(
        "source_page", "url", "true AS is_document"
    )


def link_targets(pages: DataFrame, *keep_columns: str) -> DataFrame:
    """Canonical internal targets, each once per page.

    In-page dedup works on the page's own array, so it costs no shuffle and
    spares the next one most of its rows.
    """
    targets = each(internal("hrefs", "norm"), lambda l: urls.crawl_form(f"{l}.parts"))
    return crawl_base(pages, *keep_columns).selectExpr(
        "page_id", *keep_columns, f"explode(array_distinct({targets})) AS url"
    )


def broken_links(pages: DataFrame, *group: str) -> DataFrame:
    """Internal link targets without a stored page, with the number of linking pages.

    A page names a target once, so the count needs no distinct. Counting comes
    before the anti join, so a target everybody links to is one row there.
    """
    named = link_targets(pages, *group).groupBy(*group, "url").count()
    stored = pages.selectExpr(f"{urls.crawl_form_of('url')} AS url")
    return named.join(stored, "url", "left_anti").withColumnRenamed("count", "n_referrers")
