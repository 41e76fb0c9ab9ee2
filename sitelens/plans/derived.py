"""Input relations derived from the given tables.

A production run reads stored snapshots, robots files, sitemaps and response
logs. Here each of them is computed by Spark from ``pages`` and ``events``, so
its size follows theirs. None of these plans sorts or collects a whole host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelens.operators.ranking import number_by_key, number_by_order

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_BARE = "split_part(split_part(url, '#', 1), '?', 1)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose markup is going to be parsed."""
    return pages(spark, sf_dir)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def hosted(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """``page_id, url, host, bare`` and the ``extra`` columns asked for."""
    scan = markup(spark, sf_dir) if "html" in extra else pages(spark, sf_dir)
    return scan.selectExpr("page_id", "url", f"{_HOST} AS host", f"{_BARE} AS bare", *extra)


def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host its first page and its page count, by map-side aggregation."""
    return hosted(spark, sf_dir).groupBy("host").agg(
        F.min("page_id").alias("page_id"),
        F.min_by("bare", "page_id").alias("bare"),
        F.count(F.lit(1)).alias("n_pages"),
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each host joined into a binary tree by absolute links.

    Also adds one document, one mail and one external link. Tree positions and
    children are worked out on slim rows; the markup is moved once, by page.
    """
    slim = number_by_key(
        hosted(spark, sf_dir).select("page_id", "url", "host"), ["host"], "page_id", "k"
    )
    # Every page appears once as itself and once below its parent, so one
    # aggregation brings a page and its children together.
    roles = slim.selectExpr("host", "page_id", "url", "k", "explode(array(k, k div 2)) AS node")
    tree = (
        roles.filter("node > 0")
        .groupBy("host", "node")
        .agg(
            F.max(F.expr("if(k = node, page_id, NULL)")).alias("page_id"),
            F.max(F.expr("if(k = 2 * node, url, NULL)")).alias("left_url"),
            F.max(F.expr("if(k = 2 * node + 1, url, NULL)")).alias("right_url"),
        )
        .withColumnRenamed("node", "k")
    )
    return (
        markup(spark, sf_dir)
        .join(tree, "page_id")
        .selectExpr(
            "page_id",
            "url",
            "host",
            "cast(k AS int) AS k",
            """concat(html,
                coalesce('<a href="' || left_url || '">b</a>', ''),
                coalesce('<a href="' || right_url || '">c</a>', ''),
                '<a href="/files/report-', k, '.PDF">d</a><a href="mailto:x@', host,
                '">m</a><a href="https://external.example/x">e</a>') AS html""",
        )
    )


def sites(spark: SparkSession, sf_dir: str, max_pages: str = "1000") -> DataFrame:
    """One scan request per host, starting at its first page."""
    return host_summary(spark, sf_dir).selectExpr(
        "host AS site",
        "bare AS base_url",
        "cast(page_id % 4 AS int) AS max_depth",
        f"cast({max_pages} AS bigint) AS max_pages",
        "'TestAgent/1.0' AS user_agent",
    )


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One robots file per host."""
    return host_summary(spark, sf_dir).selectExpr(
        "host AS site",
        r"""concat('User-agent: OtherBot\nDisallow: /\n\nUser-agent: *  # everyone\n',
            'Disallow: /en\nAllow: /en/', page_id % 10, '\nDisallow:\nCrawl-delay: ',
            page_id % 5) AS text""",
    )


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sitemap per page: one location filled, one empty, one blank."""
    return hosted(spark, sf_dir).selectExpr(
        "host",
        "page_id",
        """concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
            '<url><loc> ', replace(url, '&', '&amp;'), ' </loc></url>',
            '<url><loc></loc></url><url><loc> </loc></url></urlset>') AS xml""",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts: each user's events in time order, five to a URL."""
    ordered = number_by_order(
        events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value"),
        ["user_id"],
        ["ts", "event_id"],
        "rn",
    )
    # A log may hold a row twice.
    logged = ordered.withColumn("copy", F.expr("explode(if(rn % 7 = 3, array(1, 2), array(1)))"))
    return logged.selectExpr(
        "concat('http://site.example/u', user_id, '/', (rn - 1) div 5) AS url",
        "cast((rn - 1) % 5 + 1 AS int) AS attempt",
        "ts",
        """CASE WHEN value > 100 THEN NULL WHEN event_type = 'error' THEN 503
                WHEN event_type = 'signup' THEN 429 WHEN event_type = 'purchase' THEN 404
                ELSE 200 END AS status""",
        """CASE WHEN event_type = 'view' THEN 'text/HTML; charset=utf-8'
                WHEN event_type = 'click' THEN 'application/pdf' END AS content_type""",
    )


def fetched_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with raw bodies under three content types."""
    return pages(spark, sf_dir).selectExpr(
        "page_id",
        "url",
        """CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Application/JSON'
                ELSE 'text/HTML; charset=utf-8' END AS content_type""",
        "encode(html, 'UTF-8') AS body",
    )


# A page's text in another alphabet, and that alphabet's bytes as code points.
_CYRILLIC, _IN_1251, _IN_KOI8 = "абвгдежз", "àáâãäåæç", "ÁÂ×ÇÄÅÖÚ"


def charset_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in six charsets: named by a header, marked, declared in the markup, or left to be guessed.

    ``kind`` is 0: windows-1251 by the header; 1: UTF-16 with a mark; 2: windows-1252 by the
    markup; 3: UTF-16BE by the header; 4: UTF-8 behind an unknown label; 5: KOI8-R by the markup.
    """
    ascii_text = r"regexp_replace(html, r'[^\x00-\x7F]', '?')"
    cyrillic = f"translate({ascii_text}, 'abcdefgh', '{_CYRILLIC}')"

    def bytes_of(table: str, content: str) -> str:
        return f"encode(translate({content}, '{_CYRILLIC}', '{table}'), 'ISO-8859-1')"

    # The declaration must stay readable, so it stands before the translated text.
    koi8 = f"concat('<meta http-equiv=content-type content=\"text/html; charset=koi8-r\">', {cyrillic})"
    latin = r"""replace(regexp_replace(html, r'[^\x00-\xFF]', '?'), 'charset="utf-8"', 'charset=Latin1')"""
    return pages(spark, sf_dir).selectExpr("*", "page_id % 6 AS kind").selectExpr(
        "page_id",
        "url",
        """CASE kind WHEN 0 THEN 'text/html; Charset="CP-1251"' WHEN 3 THEN 'application/json;charset=utf-16be'
                WHEN 4 THEN 'text/html; charset=x-unknown' ELSE 'text/html' END AS content_type""",
        f"""CASE kind WHEN 0 THEN {bytes_of(_IN_1251, cyrillic)}
                WHEN 1 THEN concat(X'FFFE', encode(html, 'UTF-16LE')) WHEN 2 THEN encode({latin}, 'ISO-8859-1')
                WHEN 3 THEN encode(html, 'UTF-16BE') WHEN 5 THEN {bytes_of(_IN_KOI8, koi8)}
                ELSE encode(html, 'UTF-8') END AS body""",
    )


def wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw wordlist lines: padded paths, blanks and repeats."""
    paths = (
        hosted(spark, sf_dir)
        .selectExpr("concat(' ', regexp_replace(bare, '^[a-z]+://[^/]*/', ''), ' ') AS line")
    )
    per_host = host_summary(spark, sf_dir).selectExpr(
        "explode(if(n_pages > 1, array('', 'admin?x=1'), array(''))) AS line"
    )
    return paths.unionByName(per_host)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers for hidden-resource discovery."""
    answers = hosted(spark, sf_dir, "length(html) AS size").selectExpr(
        # Some are stored twice, as a file and as a folder.
        "explode(if(page_id % 6 = 1, array(bare, bare || '/'), array(bare))) AS url",
        """CASE WHEN page_id % 10 = 5 THEN 403 WHEN page_id % 15 = 0 THEN 204
                ELSE 200 END AS status""",
        "'text/html' AS content_type",
        "cast(size AS bigint) AS size",
    )
    files = host_summary(spark, sf_dir).selectExpr(
        "regexp_extract(bare, '^[a-z]+://[^/]*', 0) || '/files/report-1.PDF' AS url",
        "200 AS status",
        "'application/pdf' AS content_type",
        "1000 + page_id % 7 AS size",
    )
    return answers.unionByName(files)


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON scan request per page, many with a fault."""
    return hosted(spark, sf_dir).selectExpr(
        "page_id",
        "host AS site",
        """CASE page_id % 17 WHEN 3 THEN '{"base_url":' WHEN 5 THEN '[1]' WHEN 7 THEN 'null' ELSE concat('{',
            concat_ws(',',
                CASE WHEN page_id % 11 = 0 THEN NULL
                     WHEN page_id % 11 = 1 THEN '"base_url":"ftp://x"'
                     ELSE concat('"base_url":"', bare, '"') END,
                CASE page_id % 7 WHEN 0 THEN '"max_depth":-1' WHEN 1 THEN '"max_depth":2.0' END,
                CASE page_id % 6 WHEN 0 THEN '"max_pages":0' WHEN 1 THEN '"max_pages":50' END,
                CASE WHEN page_id % 23 = 2 THEN '"timeout":null' WHEN page_id % 9 = 0 THEN '"timeout":0.0' WHEN page_id % 9 = 1 THEN '"timeout":2.5' END,
                CASE page_id % 13 WHEN 0 THEN '"user_agent":""' END,
                CASE page_id % 8 WHEN 0 THEN '"rate_limit":-2' WHEN 1 THEN '"rate_limit":2.0' END,
                CASE page_id % 10 WHEN 0 THEN '"retry_times":-1' WHEN 1 THEN '"retry_times":1' END,
                CASE WHEN page_id % 12 = 0 THEN '"colour":"red"' END,
                CASE page_id % 29 WHEN 1 THEN '"localization":{"fr":{"subdomain":"fr."}}' WHEN 3 THEN '"localization":5'
                     WHEN 2 THEN '"localization":{"fr":{"subdomain":"fr.","path_prefix":"/fr","hreflangs":["fr"]}}' END,
                CASE WHEN page_id % 19 = 4 THEN '"wordlists":["a"]'
                     WHEN page_id % 4 = 0 THEN NULL
                     WHEN page_id % 4 = 1 THEN '"wordlists":{}'
                     WHEN page_id % 4 = 2 THEN concat('"wordlists":{"paths":"lists/', host, '.txt"}')
                     ELSE '"wordlists":{"paths":"lists/missing.txt"}' END),
            '}') END AS request""",
    )


def timed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked pages seen at quarters of an hour within ten days, every third one once more ten hours later."""
    return (
        linked_pages(spark, sf_dir)
        .selectExpr("*", "explode(if(page_id % 3 = 0, array(0, 40), array(0))) AS again")
        .selectExpr(
            "page_id",
            "host AS site",
            "url",
            "html",
            """timestamp'2024-01-01 00:00:00'
               + make_dt_interval(0, 0, cast(15 * (page_id * 37 % 960 + again) AS int), 0) AS ts""",
        )
    )


def language_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of accepted languages of each request."""
    return events(spark, sf_dir).selectExpr(
        "event_id",
        """CASE event_id % 9
            WHEN 0 THEN 'de-CH-1996;q=0.7, en;q=0.9, fr;q=0.8' WHEN 1 THEN 'es' WHEN 2 THEN '*, ja-JP ; q=0.2'
            WHEN 3 THEN 'de;q=0, zh-Hant-x-y;q=0.5' WHEN 4 THEN '' WHEN 5 THEN 'KO-kr;q=0.4,fr-FR;q=0.4'
            WHEN 6 THEN 'fr;q=high, de;q=0.1' WHEN 7 THEN 'en-GB,en' END AS accept_language""",
    )


def wordlist_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the stored wordlists, one per host."""
    return host_summary(spark, sf_dir).selectExpr("concat('lists/', host, '.txt') AS path")


def locale_rules() -> dict[str, dict]:
    """Locale settings: the three national segments and three that occur in the data."""
    # Path segments and their language tags.
    codes = {
        "jp": ("ja", "ja-JP"),
        "kr": ("ko", "ko-KR"),
        "cn": ("zh", "zh-CN"),
        "fr": ("fr", "fr-FR"),
        "de": ("de", "de-DE"),
        "es": ("es", "es-ES"),
    }
    return {
        lang: {
            "subdomain": f"{lang}.",
            "path_prefix": f"/{lang}",
            "hreflangs": list(tags),
            "accept_languages": list(tags),
        }
        for lang, tags in codes.items()
    }
