"""Breadth-first crawl of many sites at once over a stored snapshot.

Each round is one set of joins for all sites together. What a site needs to
decide its budget travels on its frontier rows, so no round joins big data on
the site alone, and a site holding a third of all pages is spread over tasks by
its URLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.functions import robots as rules
from sitelens.functions import urls
from sitelens.functions.sql import each, keep
from sitelens.operators.links import crawl_base, internal
from sitelens.operators.robots import site_rules
from sitelens.session import LeveledTable, materialize, materialize_bucketed

_KEY = ["site", "norm"]

# A link's place among the admitted ones is the long ``rank * 2**28 + pos``. A page
# text is at most 2 GB and a link takes at least eight characters, so a position
# stays below 2**28; a level of one site beyond 2**35 pages is an error.
_POS_BITS = 28
_PLACE = (
    f"if(rank < {1 << 63 - _POS_BITS}, shiftleft(rank, {_POS_BITS}) + pos,"
    " raise_error('too many pages in one level of one site'))"
)
# Parents per ranking bucket: 2**10 of them.
_BUCKET_BITS = _POS_BITS + 10


def link_graph(requests: DataFrame, snapshot: DataFrame, robots: DataFrame) -> DataFrame:
    """``site, norm, page_id, links``: admitted targets of each stored page of each site.

    ``snapshot`` has ``page_id, url, html``; a page with NULL ``html`` (a binary
    body) is stored but has no links. Robots verdicts do not depend on depth, so
    they are decided here, once per link. Of several snapshot rows with one
    canonical URL the lowest ``page_id`` counts.
    """
    wanted = site_rules(requests, robots).selectExpr(
        "site", f"lower({urls.domain_of('base_url')}) AS host", "rules"
    )
    parsed = crawl_base(snapshot)
    admitted = keep(
        internal("hrefs", "norm"), lambda l: rules.admits(f"{l}.parts.path", "rules")
    )
    targets = f"array_distinct({each(admitted, lambda l: urls.crawl_form(f'{l}.parts'))})"
    return (
        parsed.withColumn("host", F.expr(urls.domain_of("norm")))
        .join(wanted, "host")
        .selectExpr("site", "norm", "page_id", f"coalesce({targets}, array()) AS links")
        .groupBy("site", "norm")
        .agg(F.min_by("links", "page_id").alias("links"), F.min("page_id").alias("page_id"))
    )


def _seeds(requests: DataFrame) -> DataFrame:
    return requests.selectExpr(
        "site",
        f"{urls.crawl_form_of('base_url')} AS norm",
        "cast(1 AS bigint) AS rank",
        "cast(max_depth AS int) AS max_depth",
        "cast(max_pages AS bigint) AS max_pages",
        "cast(1 AS bigint) AS seen",
    )


def _candidates(found: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    """New targets of this level's pages, each at its first occurrence."""
    return (
        found.filter(F.col("max_depth") > depth)
        .selectExpr(
            "site", "max_depth", "max_pages", "seen", "rank", "posexplode(links) AS (pos, norm)"
        )
        .groupBy("site", "norm")
        .agg(
            F.min(F.expr(_PLACE)).alias("place"),
            F.max("max_depth").alias("max_depth"),
            F.max("max_pages").alias("max_pages"),
            F.max("seen").alias("seen"),
        )
        .join(visited, _KEY, "left_anti")
        .withColumn("bucket", F.expr(f"shiftright(place, {_BUCKET_BITS})"))
    )


def _admit(candidates: DataFrame) -> DataFrame:
    """Rank candidates per site and keep those the page budget admits.

    Every admission counts twice against the budget, once as visited and once as
    queued: a level that starts with V visited pages of M admits ceil((M - V) / 2).
    """
    by_site = Window.partitionBy("site")
    before = by_site.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        candidates.groupBy("site", "bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("max_pages").alias("max_pages"),
            F.max("seen").alias("seen"),
        )
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(by_site))
        .withColumn("room", F.expr("greatest((max_pages - seen + 1) div 2, 0)"))
        .filter("offset < room")
        .selectExpr(
            "site", "bucket", "offset", "room", "seen + least(total, room) AS seen_after"
        )
    )
    inside = F.row_number().over(Window.partitionBy("site", "bucket").orderBy("place"))
    return (
        candidates.join(buckets, ["site", "bucket"])
        .withColumn("rank", F.col("offset") + inside)
        .filter("rank <= room")
        .selectExpr("site", "norm", "rank", "max_depth", "max_pages", "seen_after AS seen")
    )


def crawl(requests: DataFrame, snapshot: DataFrame, robots: DataFrame) -> DataFrame:
    """Reachable pages as ``site, depth, url``; see :func:`crawl_pages`."""
    return crawl_pages(requests, snapshot, robots).select("site", "depth", "url")


def crawl_pages(requests: DataFrame, snapshot: DataFrame, robots: DataFrame) -> DataFrame:
    """Reachable pages as ``site, depth, rank, url, page_id``; see :func:`_walked`."""
    return _walked(
        requests,
        snapshot,
        robots,
        lambda visited, stored: visited.join(stored, _KEY).selectExpr(
            "site", "depth", "rank", "norm AS url", "page_id"
        ),
    )


def crawl_misses(requests: DataFrame, snapshot: DataFrame, robots: DataFrame) -> DataFrame:
    """URLs that the crawl asks for and that have no stored page: ``site, depth, url``."""
    return _walked(
        requests,
        snapshot,
        robots,
        lambda visited, stored: visited.join(stored, _KEY, "left_anti").selectExpr(
            "site", "depth", "norm AS url"
        ),
    )


def _walked(
    requests: DataFrame,
    snapshot: DataFrame,
    robots: DataFrame,
    result: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """``result`` of the visited URLs, ``site, depth, rank, norm``, and the stored ones, ``site, norm, page_id``.

    ``rank`` orders the pages of one level as a breadth-first walk meets them.

    ``requests``: ``site, base_url, max_depth, max_pages, user_agent``;
    ``snapshot``: ``page_id, url, html``; ``robots``: ``site, text``. The seed is
    never checked against robots. A URL without a stored page counts as visited
    but gives no page.

    The visited table has a level for each round, in the buckets of the graph. A round
    reads its frontier, the graph and the visited keys in place and moves only the links
    that it meets; its admitted ones are moved once, to be the next level.
    """
    requests = materialize(requests, "requests")
    graph = materialize_bucketed(link_graph(requests, snapshot, robots), "graph", _KEY)
    deepest = requests.agg(F.max("max_depth")).head()[0]
    visited = LeveledTable(requests.sparkSession, "visited", _KEY)
    try:
        visited.append(_seeds(requests), 0)
        for depth in range(deepest or 0):
            found = visited.level(depth).join(graph, _KEY)
            seen = visited.all().select(*_KEY)
            candidates = materialize(_candidates(found, seen, depth), "candidates")
            visited.append(_admit(candidates), depth + 1)
            if visited.level(depth + 1).isEmpty():
                break
        walked = visited.all().selectExpr("site", "level AS depth", "rank", "norm")
        return materialize(result(walked, graph.select("site", "norm", "page_id")), "walked")
    finally:
        visited.close()
