"""The registered queries: each composes operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelens.functions import urls
from sitelens.functions.sql import let
from sitelens.operators import admission, crawl, dedup, links, locales, outcomes, rates, robots
from sitelens.operators.discovery import hidden_resources
from sitelens.operators.ranking import number_by_order
from sitelens.plans import derived, report, scan
from sitelens.session import materialize, scratch_path, tune, write_table
from sitelens.sources import documents, reports, requests, sitemaps, snapshots, wordlists
from sitelens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_AGENT = "'TestAgent/1.0'"
# Files of a stored table that is streamed, half of them in a batch.
_STREAM_FILES = 8
# Parts of a table that is streamed in the order of its times; watermarks allow for one.
_SLICES = 4
_RATE_LIMIT, _RATE_WINDOW, _RATE_DELAY = 3, "1 day", "1 hour"


def query(run: Query) -> Query:
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tune(spark), sf_dir)

    QUERIES[run.__name__] = tuned
    return tuned


def _as_host(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("site", "host")


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.hosted(spark, sf_dir).selectExpr(f"{urls.site_root_of('bare')} AS base")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordlists.multiplicities(wordlists.entries(derived.wordlist(spark, sf_dir)))


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.linked_pages(spark, sf_dir).withColumnRenamed("host", "site")


# Scans and sources


@query
def page_scan(spark, sf_dir):
    scanned = snapshots.page_scan(derived.fetched_bodies(spark, sf_dir), "page_id")
    return scanned.selectExpr(
        "page_id", "url", "text IS NOT NULL AS is_text", "cast(length(text) AS bigint) AS n_chars"
    )


@query
def charset_scan(spark, sf_dir):
    """Text of bodies in six charsets."""
    scanned = snapshots.page_scan(derived.charset_bodies(spark, sf_dir), "page_id")
    return scanned.selectExpr("page_id", "charset", "sha2(cast(text AS binary), 256) AS text_sha256")


@query
def fetch_outcomes(spark, sf_dir):
    return outcomes.fetch_outcomes(derived.attempts(spark, sf_dir))


@query
def wordlist_entries(spark, sf_dir):
    return _words(spark, sf_dir)


@query
def robots_directives(spark, sf_dir):
    return _as_host(robots.directives(derived.robots(spark, sf_dir)))


@query
def robots_rules(spark, sf_dir):
    return _as_host(robots.rule_lists(derived.robots(spark, sf_dir), _AGENT))


@query
def sitemap_urls(spark, sf_dir):
    return sitemaps.sitemap_urls(derived.sitemaps(spark, sf_dir), "host", "page_id")


@query
def request_violations(spark, sf_dir):
    return _as_host(
        requests.violations(
            derived.raw_requests(spark, sf_dir),
            derived.wordlist_catalogue(spark, sf_dir),
            "site",
            "page_id",
        )
    )


# URL forms


@query
def url_canonical(spark, sf_dir):
    def forms(p: str) -> str:
        return (
            f"named_struct('crawl_form', {urls.crawl_form(p)}, 'parsed_form', {urls.parsed_form(p)},"
            f" 'dir_form', {urls.directory_form(p)}, 'domain', {p}.authority)"
        )

    return (
        derived.pages(spark, sf_dir)
        .selectExpr("page_id", f"{let(urls.parse('url'), forms)} AS f", f"{urls.bare_path('url')} AS bare")
        .select("page_id", "f.*", "bare")
    )


@query
def resolved_links(spark, sf_dir):
    return links.resolved_links(derived.linked_pages(spark, sf_dir))


@query
def url_segments(spark, sf_dir):
    located = derived.hosted(spark, sf_dir).select("host", "url")
    return (
        locales.url_segments(located, "host")
        .groupBy("host", "segment")
        .count()
        .withColumnRenamed("count", "n")
    )


# HTML extraction


@query
def internal_links(spark, sf_dir):
    return links.internal_links(derived.linked_pages(spark, sf_dir))


@query
def parsed_pages(spark, sf_dir):
    parsed = links.parsed_pages(derived.linked_pages(spark, sf_dir), fields=("hrefs", "title"))
    return parsed.selectExpr("page_id", "title", "size(links) AS n_links")


@query
def parsed_page_values(spark, sf_dir):
    """What a parsed page holds: its links, title, headings and named meta tags."""
    parsed = links.parsed_pages(
        derived.linked_pages(spark, sf_dir), fields=("hrefs", "title", "headings", "meta", "html_lang")
    )
    return parsed.selectExpr(
        "page_id",
        "title",
        "html_lang",
        "array_join(links, ' ') AS links",
        "to_json(headings) AS headings",
        "to_json(meta) AS meta",
    )


@query
def page_text(spark, sf_dir):
    return links.parsed_pages(derived.markup(spark, sf_dir), fields=("text",)).select(
        "page_id", "text"
    )


@query
def same_host_links(spark, sf_dir):
    return links.same_host_links(
        links.parsed_pages(derived.linked_pages(spark, sf_dir), fields=("hrefs",))
    )


@query
def raw_hrefs(spark, sf_dir):
    return links.raw_href_rows(derived.linked_pages(spark, sf_dir))


@query
def page_metadata(spark, sf_dir):
    parsed = links.parsed_pages(
        derived.markup(spark, sf_dir), fields=("html_lang", "meta", "headings")
    )
    return parsed.selectExpr(
        "page_id",
        "html_lang",
        "size(meta) AS n_meta",
        "array_join(coalesce(headings['h1'], array()), '|') AS h1",
    )


# Joins


@query
def document_links(spark, sf_dir):
    return links.document_links(
        links.parsed_pages(derived.linked_pages(spark, sf_dir), fields=("hrefs",))
    )


@query
def robots_admission(spark, sf_dir):
    rules = robots.site_rules(derived.sites(spark, sf_dir), derived.robots(spark, sf_dir))
    return admission.link_verdicts(_site_pages(spark, sf_dir), rules)


@query
def hidden_resources_found(spark, sf_dir):
    found = hidden_resources(
        _bases(spark, sf_dir), _words(spark, sf_dir), derived.responses(spark, sf_dir)
    )
    return found.select("base", "url", "status")


@query
def broken_links(spark, sf_dir):
    return links.broken_links(derived.linked_pages(spark, sf_dir), "host")


# Aggregation and dedup


@query
def stable_dedup(spark, sf_dir):
    found = links.internal_links(derived.linked_pages(spark, sf_dir), "host")
    first = dedup.stable(found, ["host", "link"], "page_id", "pos")
    return first.selectExpr("host", "link AS url", "page_id AS first_page", "pos AS first_pos")


@query
def distinct_links(spark, sf_dir):
    return dedup.unordered(
        links.link_targets(derived.linked_pages(spark, sf_dir), "host"), ["host", "url"]
    )


@query
def duplicate_counts(spark, sf_dir):
    found = links.internal_links(derived.linked_pages(spark, sf_dir), "host")
    return dedup.duplicate_counts(found, "host", "link")


# Crawl


@query
def crawl_reachable(spark, sf_dir):
    return _as_host(
        crawl.crawl(
            derived.sites(spark, sf_dir),
            derived.linked_pages(spark, sf_dir),
            derived.robots(spark, sf_dir),
        )
    )


@query
def crawl_misses(spark, sf_dir):
    return _as_host(
        crawl.crawl_misses(
            derived.sites(spark, sf_dir),
            derived.linked_pages(spark, sf_dir),
            derived.robots(spark, sf_dir),
        )
    )


@query
def requested_crawl(spark, sf_dir):
    """From raw JSON requests, one per host, to the pages that the sound ones reach."""
    firsts = derived.host_summary(spark, sf_dir).select("page_id")
    accepted = requests.accepted(
        derived.raw_requests(spark, sf_dir).join(firsts, "page_id"),
        derived.wordlist_catalogue(spark, sf_dir),
        "page_id",
    )
    return _as_host(
        crawl.crawl(accepted, derived.linked_pages(spark, sf_dir), derived.robots(spark, sf_dir))
    )


@query
def crawl_budget(spark, sf_dir):
    """Three levels under budgets of which some bind early, some late."""
    requested = derived.sites(spark, sf_dir, max_pages="8 + 16 * (page_id % 5)").withColumn(
        "max_depth", F.lit(3)
    )
    return _as_host(
        crawl.crawl(
            requested, derived.linked_pages(spark, sf_dir), derived.robots(spark, sf_dir)
        )
    )


# Locales


@query
def localized_urls(spark, sf_dir):
    return locales.localized_urls(derived.linked_pages(spark, sf_dir), "host")


@query
def page_locales(spark, sf_dir):
    return locales.page_locales(derived.markup(spark, sf_dir), derived.locale_rules()).select(
        "page_id", "lang"
    )


@query
def request_locales(spark, sf_dir):
    """The locale that each request's header of accepted languages asks for."""
    return locales.request_locales(
        derived.language_headers(spark, sf_dir), derived.locale_rules(), "accept_language", "event_id"
    )


# Report


@query
def report_pages(spark, sf_dir):
    entries = report.parsed_entries(_site_pages(spark, sf_dir))
    return _as_host(report.pages_table(entries)).selectExpr(
        "host",
        "url",
        "size(links) AS n_links",
        "size(meta) AS n_meta",
        "size(headings) AS n_headings",
        "size(headers) AS n_headers",
    )


@query
def report_documents(spark, sf_dir):
    entries = report.parsed_entries(_site_pages(spark, sf_dir), ("hrefs",))
    table = report.documents_table(entries, derived.responses(spark, sf_dir))
    return _as_host(table).select("host", "name", "url", "size", "mime")


@query
def report_hidden(spark, sf_dir):
    table = report.hidden_table(
        _bases(spark, sf_dir), _words(spark, sf_dir), derived.responses(spark, sf_dir)
    )
    return _as_host(table)


@query
def report_locales(spark, sf_dir):
    pages = derived.hosted(spark, sf_dir, "html").selectExpr("*", "host AS site", "0 AS k")
    entries = report.parsed_entries(pages, locales.LANGUAGE_FIELDS)
    return _as_host(report.locales_table(entries, derived.locale_rules()))


@query
def last_entry_locales(spark, sf_dir):
    """Locale lists of each site's last page."""
    located = derived.hosted(spark, sf_dir, "html").withColumnRenamed("host", "site")
    named = locales.page_locales(located, derived.locale_rules(), "site")
    entries = (
        named.groupBy("site", "page_id")
        .agg(F.collect_list(F.struct("lang", F.array("url"))).alias("found"))
        .selectExpr("site", "page_id AS seq", "map_from_entries(found) AS locales")
    )
    last = located.groupBy("site").agg(F.max("page_id").alias("seq"))
    whole = last.join(entries, ["site", "seq"], "left").selectExpr(
        "site", "seq", "coalesce(locales, cast(map() AS map<string,array<string>>)) AS locales"
    )
    return _as_host(report.last_entry_locales(whole)).selectExpr(
        "host", "lang", "array_join(urls, ' ') AS urls"
    )


def _report_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four flat tables; pages are parsed once and read back slim."""
    entries = materialize(report.parsed_entries(_site_pages(spark, sf_dir)), "entries")
    responses = derived.responses(spark, sf_dir)
    return {
        "pages": report.pages_table(entries),
        "documents": report.documents_table(entries, responses),
        "hidden": report.hidden_table(_bases(spark, sf_dir), _words(spark, sf_dir), responses),
        "locales": report.locales_table(entries, derived.locale_rules()),
    }


@query
def site_report(spark, sf_dir):
    """Counts need no sizes and no positions; pages are parsed once."""
    entries = materialize(
        report.parsed_entries(_site_pages(spark, sf_dir), ("hrefs", *locales.LANGUAGE_FIELDS)), "entries"
    )
    return _as_host(
        report.counts(
            derived.sites(spark, sf_dir),
            pages=entries,
            documents=report.document_entries(entries),
            hidden=report.hidden_table(
                _bases(spark, sf_dir), _words(spark, sf_dir), derived.responses(spark, sf_dir)
            ),
            locales=locales.classify(entries, derived.locale_rules(), "site"),
        )
    )


@query
def scan_report(spark, sf_dir):
    """Crawl of every site, then the report of the pages it reached."""
    sites = derived.sites(spark, sf_dir)
    tables = scan.scan(
        sites,
        derived.linked_pages(spark, sf_dir),
        derived.robots(spark, sf_dir),
        _words(spark, sf_dir),
        derived.responses(spark, sf_dir),
        derived.locale_rules(),
    )
    return _as_host(report.counts(sites, **tables))


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_rows(derived.sites(spark, sf_dir), **_report_tables(spark, sf_dir))


def _field(name: str) -> str:
    return f"get_json_object(json, '$.{name}')"


def _entry_values(rows: DataFrame) -> DataFrame:
    """Values read back from the JSON text of each entry."""
    return _as_host(reports.as_json(rows)).selectExpr(
        "host",
        "section",
        "seq",
        f"{_field('url')} AS url",
        f"cast(json_array_length({_field('links')}) AS int) AS n_links",
        f"cast({_field('size')} AS bigint) AS size",
        f"coalesce({_field('mime')}, {_field('type')}, {_field('lang')}) AS kind",
        f"cast({_field('status')} AS int) AS status",
    )


@query
def site_report_json(spark, sf_dir):
    return _entry_values(_report_rows(spark, sf_dir))


def _placed_pieces(spark: SparkSession, sf_dir: str, pretty: bool) -> DataFrame:
    """Every piece of every site's document with its place in it."""
    rows = materialize(_report_rows(spark, sf_dir), "report-rows")
    placed = number_by_order(documents.pieces(rows, pretty), ["site"], list(documents.PLACE), "place")
    return _as_host(placed).select("host", "place", "text")


@query
def site_documents(spark, sf_dir):
    return _placed_pieces(spark, sf_dir, pretty=True)


@query
def site_documents_compact(spark, sf_dir):
    return _placed_pieces(spark, sf_dir, pretty=False)


@query
def loaded_documents(spark, sf_dir):
    """Reports written as documents and loaded from them again."""
    path = scratch_path(spark, "documents")
    documents.write_documents(_report_rows(spark, sf_dir), path)
    return _entry_values(documents.read_documents(spark, path))


@query
def report_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "reports")
    reports.write_reports(_report_rows(spark, sf_dir), path)
    read = reports.read_reports(spark, path)
    return _as_host(
        read.groupBy("site").agg(
            *(F.expr(f"count_if(section = '{s}')").alias(f"n_{s}") for s in report.SECTIONS),
            F.expr("cast(coalesce(sum(size(page.links)), 0) AS bigint)").alias("n_links"),
            F.expr("cast(coalesce(sum(document.size), 0) AS bigint)").alias("document_bytes"),
            F.expr("cast(coalesce(sum(hidden.size), 0) AS bigint)").alias("hidden_bytes"),
            F.expr("max(locale.url)").alias("last_locale_url"),
        )
    )


# Streams


@query
def stream_new_links(spark, sf_dir):
    pages = _site_pages(spark, sf_dir)
    stream = jobs.stream_of(pages, write_table(pages.repartition(_STREAM_FILES), "pages"), _STREAM_FILES // 2)
    return _as_host(jobs.run_new_links(stream))


@query
def stream_fetch_outcomes(spark, sf_dir):
    attempts = derived.attempts(spark, sf_dir)
    folder = write_table(attempts.repartition(_STREAM_FILES), "attempts")
    return jobs.run_fetch_outcomes(jobs.stream_of(attempts, folder, _STREAM_FILES // 2))


@query
def stream_recent_links(spark, sf_dir):
    """Links that are new again after some hours without a mention."""
    stream = jobs.write_by_time(derived.timed_pages(spark, sf_dir), "timed-pages", "ts", _SLICES)
    return _as_host(jobs.run_recent_links(stream, "ts", "3 hours 7 minutes", "3 days 1 minute"))


@query
def stream_due_retries(spark, sf_dir):
    """Retries that came due, with an hour as the unit."""
    attempts = derived.attempts(spark, sf_dir).withColumn("ts", F.expr("cast(ts AS timestamp)"))
    stream = jobs.write_by_time(attempts, "timed-attempts", "ts", _SLICES)
    due = jobs.run_due_retries(stream, "8 days", unit_s=3600)
    return due.selectExpr("url", "attempt", "cast(due AS timestamp_ntz) AS due")


@query
def rate_bursts(spark, sf_dir):
    """Moments at which a site had more than two requests in six hours."""
    asked = derived.events(spark, sf_dir).selectExpr("user_id AS site", "ts")
    return rates.bursts(asked, 2, "6 hours")


@query
def rate_audit(spark, sf_dir):
    events = derived.events(spark, sf_dir)
    stream = (
        spark.readStream.schema(events.schema)
        # A pattern: the table may be one file or a folder of part files.
        .parquet(f"{sf_dir}/events.parque[t]")
        .selectExpr("user_id AS site", "cast(ts AS timestamp) AS ts")
    )
    return jobs.run_rate_audit(stream, _RATE_LIMIT, _RATE_WINDOW, _RATE_DELAY)


# The planned key of hidden-resource discovery is the operator's own name.
QUERIES["hidden_resources"] = QUERIES.pop("hidden_resources_found")
