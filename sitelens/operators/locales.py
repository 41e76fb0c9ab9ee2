"""Locale operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.functions import urls
from sitelens.functions.html import raw_hrefs
from sitelens.functions.markup import with_fields
from sitelens.functions.sql import each, each_indexed, keep, let, raw, struct, text, texts

LANGUAGE_FIELDS = ("html_lang", "hreflangs")


def localized_urls(pages: DataFrame, base_domain: str) -> DataFrame:
    """Raw hrefs in directory form that lie in ``base_domain``, an expression per page.

    Order and duplicates are kept; relative hrefs have no domain and drop out.
    """

    def localized(found: str) -> str:
        parts = urls.parse_each(found)
        directories = each(
            parts,
            lambda p: struct(
                url=urls.directory_form(p), inside=urls.in_domain(p, base_domain)
            ),
        )
        return keep(directories, lambda d: f"{d}.inside")

    return (
        pages.withColumn("found", raw_hrefs(pages["html"]))
        .selectExpr("page_id", f"posexplode({localized('found')}) AS (pos, l)")
        .selectExpr("page_id", "pos", "l.url AS url")
    )


def url_segments(located: DataFrame, base_domain: str) -> DataFrame:
    """First path segment of in-domain URLs; URLs without one drop out."""
    segment = let(
        urls.parse("url"),
        lambda p: (
            f"if({urls.in_domain(p, base_domain)}, {urls.first_segment(p)}, NULL)"
        ),
    )
    return located.selectExpr("*", f"{segment} AS segment").filter("segment IS NOT NULL")


def page_locales(pages: DataFrame, rules: dict[str, dict], *keep_columns: str) -> DataFrame:
    """Locales of each page; a page may have several."""
    parsed = with_fields(pages.select("page_id", *keep_columns, "url", "html"), LANGUAGE_FIELDS)
    return classify(
        parsed.selectExpr("page_id", *keep_columns, "url", "page.html_lang", "page.hreflangs"),
        rules,
        *keep_columns,
    )


def classify(parsed: DataFrame, rules: dict[str, dict], *keep_columns: str) -> DataFrame:
    """Locales of parsed pages: by subdomain, path prefix, or language of the markup.

    ``rules`` is configuration (a few locales), so it becomes conditions of one
    projection and no join.
    """

    def matched(p: str) -> str:
        tests = []
        for lang, rule in rules.items():
            prefix = rule["path_prefix"].rstrip("/")
            tests.append(
                f"if(startswith({p}.authority, {text(rule['subdomain'])})"
                f" OR {p}.path = {text(prefix)} OR startswith({p}.path, {text(prefix + '/')})"
                f" OR coalesce(arrays_overlap(langs, array({texts(rule['hreflangs'])})), false),"
                f" {text(lang)}, NULL)"
            )
        return f"array_compact(array({', '.join(tests)}))"

    return parsed.selectExpr(
        "page_id",
        *keep_columns,
        "url",
        "array_compact(concat(array(html_lang), hreflangs)) AS langs",
    ).selectExpr(
        "page_id", *keep_columns, "url", f"explode({let(urls.parse('url'), matched)}) AS lang"
    )


_RANGE = r"^\s*([a-z0-9*]{1,8}(?:-[a-z0-9*]{1,8})*)\s*(?:;\s*q\s*=\s*(0(?:\.[0-9]{0,3})?|1(?:\.0{0,3})?)\s*)?$"


def request_locales(requests: DataFrame, rules: dict[str, dict], header: str, *keep_columns: str) -> DataFrame:
    """The locale that each request asks for by its ``header`` of accepted languages, or NULL.

    Ranges count by weight, then by place. A range is looked up among the
    ``accept_languages`` of the rules, then without its last subtags one after the other,
    a single letter going with the one behind it. Weight 0 excludes a range, ``*`` names
    no locale, and what is no range is passed over. A tag of several locales is the
    first's.
    """
    tags: dict[str, str] = {}
    for lang, rule in rules.items():
        for tag in rule["accept_languages"]:
            tags.setdefault(tag.lower(), lang)
    table = "map(" + ", ".join(f"{text(t)}, {text(lang)}" for t, lang in tags.items()) + ")" if tags else "map('', '')"

    def locale(tag: str) -> str:
        def shortened(parts: str) -> str:
            cuts = keep(
                f"sequence(size({parts}), 1, -1)",
                lambda n: f"{n} = size({parts}) OR length(element_at({parts}, {n})) > 1",
            )
            return each(cuts, lambda n: f"try_element_at({table}, array_join(slice({parts}, 1, {n}), '-'))")

        return f"try_element_at(array_compact({let(f"split({tag}, '-')", shortened)}), 1)"

    def weighted(item: str, place: str) -> str:
        tag, weight = (f"regexp_extract({item}, {raw(_RANGE)}, {g})" for g in (1, 2))
        return struct(
            weight=f"if({weight} = '', 1.0D, cast({weight} AS double))", place=f"-{place}", lang=locale(tag)
        )

    ranges = f"split(lower(coalesce({header}, '')), ',')"
    known = keep(each_indexed(ranges, weighted), lambda r: f"{r}.lang IS NOT NULL AND {r}.weight > 0")
    return requests.selectExpr(*keep_columns, f"array_max({known}).lang AS lang")
