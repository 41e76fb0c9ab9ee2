"""DuckDB SQL for each query, over the given tables only.

Each text states its inputs as common table expressions, in plain SQL that does
not follow the Spark plans: whole-host windows, pair joins and a recursive walk.
"""

from __future__ import annotations

_CTE: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _with(*names: str, select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({_CTE[n]})" for n in names) + "\n" + select


def _bare(url: str) -> str:
    return f"split_part(split_part({url}, '#', 1), '?', 1)"


def _crawl_form(url: str) -> str:
    return f"regexp_replace({_bare(url)}, '/+$', '')"


def _authority(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)"


def _decoded(text: str) -> str:
    """The references that occur in the given pages; ``&amp`` needs no semicolon."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"')):
        text = f"replace({text}, '&{name};', '{char}')"
    return f"regexp_replace({text}, '&amp\\b;?', '&', 'g')"


def _dir_form(url: str) -> str:
    bare = _bare(url)
    path = f"regexp_replace({bare}, '^[a-z]+://[^/]*', '')"
    return (
        f"CASE WHEN {path} = '' OR {path} LIKE '%/' OR regexp_matches({path}, '[^/]\\.[^./]+$')"
        f" THEN {bare} ELSE {bare} || '/' END"
    )


_CTE["hosted_pages"] = f"""
SELECT page_id, url, html, host, bare,
       row_number() OVER (PARTITION BY host ORDER BY page_id) AS k
FROM (SELECT page_id, url, html, {_authority('url')} AS host, {_bare('url')} AS bare FROM pages) p"""

_CTE["linked_pages"] = """
SELECT a.page_id, a.url, a.host, a.k,
       a.html || coalesce('<a href="' || b.url || '">b</a>', '')
              || coalesce('<a href="' || c.url || '">c</a>', '')
              || '<a href="/files/report-' || CAST(a.k AS VARCHAR)
              || '.PDF">d</a><a href="mailto:x@' || a.host
              || '">m</a><a href="https://external.example/x">e</a>' AS html
FROM hosted_pages a
LEFT JOIN hosted_pages b ON b.host = a.host AND b.k = 2 * a.k
LEFT JOIN hosted_pages c ON c.host = a.host AND c.k = 2 * a.k + 1"""

_CTE["sites"] = """
SELECT host, bare AS base_url, page_id % 4 AS max_depth FROM hosted_pages WHERE k = 1"""

_CTE["robots"] = """
SELECT host, concat('User-agent: OtherBot', chr(10), 'Disallow: /', chr(10), chr(10),
       'User-agent: *  # everyone', chr(10), 'Disallow: /en', chr(10),
       'Allow: /en/', CAST(page_id % 10 AS VARCHAR), chr(10), 'Disallow:', chr(10),
       'Crawl-delay: ', CAST(page_id % 5 AS VARCHAR)) AS text
FROM hosted_pages WHERE k = 1"""

_CTE["robots_lines"] = """
SELECT host, pos, lower(trim(split_part(line, ':', 1))) AS key,
       trim(substr(line, strpos(line, ':') + 1)) AS value,
       sum(CASE WHEN lower(trim(split_part(line, ':', 1))) = 'user-agent' THEN 1 ELSE 0 END)
           OVER (PARTITION BY host ORDER BY pos) AS group_no
FROM (SELECT host, generate_subscripts(ls, 1) AS pos, trim(split_part(unnest(ls), '#', 1)) AS line
      FROM (SELECT host, string_split(text, chr(10)) AS ls FROM robots) t) l
WHERE line <> ''"""

_CTE["directives"] = """
SELECT d.host, CAST(d.group_no AS INTEGER) AS group_no, a.value AS agent,
       CAST(row_number() OVER (PARTITION BY d.host, d.group_no ORDER BY d.pos) AS INTEGER) AS seq,
       d.key AS directive, d.value
FROM robots_lines d
JOIN robots_lines a ON a.host = d.host AND a.group_no = d.group_no AND a.key = 'user-agent'
WHERE d.key = 'allow' OR (d.key = 'disallow' AND d.value <> '')"""

_CTE["agent_rules"] = """
SELECT d.* FROM directives d
JOIN (SELECT host, min(group_no) AS group_no FROM directives
      WHERE agent = '*' OR starts_with('testagent/1.0', lower(agent)) GROUP BY host) g
  ON g.host = d.host AND g.group_no = d.group_no"""

_MARKUP = (
    "regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>',"
    " '', 'g')"
)

_CTE["hrefs"] = f"""
SELECT page_id, url, host, generate_subscripts(l, 1) - 1 AS pos,
       replace(unnest(l), '&amp;', '&') AS href
FROM (SELECT page_id, url, host,
             regexp_extract_all({_MARKUP}, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS l
      FROM linked_pages) x"""

_CTE["resolved"] = f"""
SELECT page_id, url, host, CAST(pos AS INTEGER) AS pos, href,
       CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href
            WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href END
       AS link
FROM hrefs WHERE NOT starts_with(href, 'mailto:') AND NOT starts_with(href, 'javascript:')"""

_CTE["internal"] = f"""
SELECT *, {_crawl_form('link')} AS norm,
       regexp_replace({_bare('link')}, '^[a-z]+://[^/]*', '') AS path
FROM resolved WHERE regexp_matches(link, '^https?:') AND {_authority('link')} = host"""

_CTE["parsed_links"] = f"""
SELECT page_id, url, host, {_crawl_form('link')} AS link, min(pos) AS first_pos
FROM resolved GROUP BY ALL"""

_CTE["parsed_ranked"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_pos) - 1 AS INTEGER) AS pos
FROM parsed_links"""

_CTE["verdicts"] = """
SELECT i.page_id, i.pos, i.link, i.host, i.norm,
       coalesce(arg_max(r.directive, r.seq) = 'allow', true) AS allowed
FROM internal i
LEFT JOIN agent_rules r ON r.host = i.host AND r.value <> '' AND starts_with(i.path, r.value)
GROUP BY ALL"""

_CTE["snapshot"] = f"""
SELECT {_crawl_form('url')} AS norm, min(page_id) AS page_id FROM pages GROUP BY 1"""

_CTE["edges"] = """
SELECT s.norm AS src, v.host, v.norm AS dst, min(v.pos) AS pos
FROM verdicts v JOIN snapshot s ON s.page_id = v.page_id WHERE v.allowed GROUP BY ALL"""

_CTE["attempts"] = """
SELECT concat('http://site.example/u', CAST(user_id AS VARCHAR), '/',
              CAST(CAST(floor((rn - 1) / 5) AS INT) AS VARCHAR)) AS url,
       CAST((rn - 1) % 5 + 1 AS INT) AS attempt, ts,
       CASE WHEN value > 100 THEN NULL WHEN event_type = 'error' THEN 503
            WHEN event_type = 'signup' THEN 429 WHEN event_type = 'purchase' THEN 404
            ELSE 200 END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events) e"""

_CTE["wordlist"] = """
SELECT concat(' ', regexp_replace(bare, '^[a-z]+://[^/]*/', ''), ' ') AS line
FROM hosted_pages
UNION ALL SELECT '' AS line FROM hosted_pages WHERE k = 1
UNION ALL SELECT 'admin?x=1' AS line FROM hosted_pages WHERE k = 2"""

_CTE["words"] = "SELECT trim(line) AS word FROM wordlist WHERE trim(line) <> ''"

_CTE["responses"] = """
SELECT regexp_extract(bare, '^[a-z]+://[^/]*') || '/files/report-1.PDF' AS url, 200 AS status,
       'application/pdf' AS content_type, 1000 + page_id % 7 AS size
FROM hosted_pages WHERE k = 1
UNION ALL
SELECT unnest(CASE WHEN page_id % 6 = 1 THEN [bare, bare || '/'] ELSE [bare] END) AS url, CASE WHEN page_id % 10 = 5 THEN 403 WHEN page_id % 15 = 0 THEN 204
       ELSE 200 END AS status, 'text/html' AS content_type, CAST(length(html) AS BIGINT) AS size
FROM hosted_pages"""

_CTE["bases"] = "SELECT DISTINCT regexp_extract(bare, '^[a-z]+://[^/]*') AS base FROM hosted_pages"

_CTE["hidden"] = f"""
SELECT c.base, c.target AS url, r.status, r.content_type, r.size
FROM (SELECT base, {_dir_form("(base || '/' || word)")} AS target FROM bases CROSS JOIN words) c
JOIN (SELECT *, {_dir_form('url')} AS target FROM responses WHERE status BETWEEN 200 AND 299
      QUALIFY row_number() OVER (PARTITION BY {_dir_form('url')} ORDER BY status, content_type, size) = 1) r
  ON r.target = c.target"""

_CTE["locale_rules"] = """
SELECT * FROM (VALUES ('jp', ['ja', 'ja-JP']), ('kr', ['ko', 'ko-KR']), ('cn', ['zh', 'zh-CN']),
                      ('fr', ['fr', 'fr-FR']), ('de', ['de', 'de-DE']), ('es', ['es', 'es-ES']))
              t(lang, tags)"""

_CTE["located"] = """
SELECT p.page_id, p.host, p.url, r.lang
FROM (SELECT *, regexp_replace(bare, '^[a-z]+://[^/]*', '') AS path,
             regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS html_lang
      FROM hosted_pages) p
JOIN locale_rules r ON starts_with(p.host, r.lang || '.') OR p.path = '/' || r.lang
     OR starts_with(p.path, '/' || r.lang || '/') OR list_contains(r.tags, p.html_lang)"""

_LINKS = ("hosted_pages", "linked_pages", "hrefs", "resolved", "internal")
_PARSED = ("hosted_pages", "linked_pages", "hrefs", "resolved", "parsed_links", "parsed_ranked")
_HIDDEN = ("hosted_pages", "wordlist", "words", "responses", "bases", "hidden")
_VERDICTS = _LINKS + ("robots", "robots_lines", "directives", "agent_rules", "verdicts")
_DOCUMENT = "regexp_matches(lower(link), '\\.(pdf|docx?|xlsx?|pptx?)$')"

_OUTCOMES = """
, tried AS (
  SELECT url, attempt, status, status IS NULL OR NOT (status IN (0, 429) OR status BETWEEN 500 AND 599) AS final
  FROM attempts WHERE attempt <= 4),
-- The row that decides: the first final one, else the last one that was made.
deciding AS (
  SELECT * FROM tried
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY final DESC, CASE WHEN final THEN attempt ELSE -attempt END) = 1)
SELECT url,
       CASE WHEN NOT final THEN CASE attempt WHEN 4 THEN 'exhausted' ELSE 'pending' END
            WHEN status IS NULL THEN 'timeout' WHEN status = 404 THEN 'not_found' ELSE 'page' END AS outcome,
       attempt AS attempts, CASE WHEN final THEN status END AS status,
       CAST(CASE WHEN final THEN [0, 2, 6, 14] ELSE [2, 6, 14, 14] END[attempt] AS INT) AS backoff_s
FROM deciding"""

ORACLES["page_scan"] = """
SELECT page_id, url, page_id % 5 <> 0 AS is_text,
       CASE WHEN page_id % 5 <> 0 THEN CAST(length(html) AS BIGINT) END AS n_chars
FROM pages"""
_ASCII = "regexp_replace(html, '[^\\x00-\\x7F]', '?', 'g')"
ORACLES["charset_scan"] = f"""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'windows-1251' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'windows-1252'
                WHEN 3 THEN 'utf-16be' WHEN 4 THEN 'utf-8' ELSE 'koi8-r' END AS charset,
       sha256(CASE page_id % 6 WHEN 0 THEN translate({_ASCII}, 'abcdefgh', 'абвгдежз')
           WHEN 2 THEN replace(regexp_replace(html, '[^\\x00-\\xFF]', '?', 'g'), 'charset="utf-8"', 'charset=Latin1')
           WHEN 5 THEN '<meta http-equiv=content-type content="text/html; charset=koi8-r">'
                       || translate({_ASCII}, 'abcdefgh', 'абвгдежз')
           ELSE html END) AS text_sha256
FROM pages"""
ORACLES["fetch_outcomes"] = _with("attempts", select="") + _OUTCOMES
ORACLES["stream_fetch_outcomes"] = ORACLES["fetch_outcomes"]
ORACLES["wordlist_entries"] = _with(
    "hosted_pages", "wordlist", "words", select="SELECT word, count(*) AS n FROM words GROUP BY word"
)
ORACLES["robots_directives"] = _with(
    "hosted_pages", "robots", "robots_lines", "directives", select="SELECT * FROM directives"
)
ORACLES["robots_rules"] = _with(
    "hosted_pages",
    "robots",
    "robots_lines",
    select="""
SELECT l.host, l.key AS kind,
       CAST(row_number() OVER (PARTITION BY l.host, l.key ORDER BY l.pos) - 1 AS INTEGER) AS pos,
       l.value, d.crawl_delay
FROM robots_lines l
JOIN robots_lines a ON a.host = l.host AND a.group_no = l.group_no AND a.key = 'user-agent'
LEFT JOIN (SELECT host, CAST(arg_max(value, pos) AS DOUBLE) AS crawl_delay
           FROM robots_lines WHERE key = 'crawl-delay' GROUP BY host) d ON d.host = l.host
WHERE (a.value = '*' OR contains('testagent/1.0', lower(a.value)))
  AND (l.key = 'allow' OR (l.key = 'disallow' AND l.value <> ''))""",
)
ORACLES["sitemap_urls"] = _with(
    "hosted_pages",
    select="""
SELECT host, page_id, CAST(0 AS INTEGER) AS pos, trim(url) AS url FROM hosted_pages
UNION ALL SELECT host, page_id, CAST(1 AS INTEGER), '' FROM hosted_pages""",
)
ORACLES["request_violations"] = _with(
    "hosted_pages",
    select="""
SELECT host, page_id, unnest(CASE WHEN page_id % 17 IN (3, 5, 7) THEN ['not a JSON object'] ELSE list_filter([
    CASE WHEN page_id % 11 = 0 THEN 'base_url missing' WHEN page_id % 11 = 1 THEN 'base_url not http' END,
    CASE WHEN page_id % 7 = 0 THEN 'max_depth' END,
    CASE WHEN page_id % 6 = 0 THEN 'max_pages' END,
    CASE WHEN page_id % 23 = 2 OR page_id % 9 = 0 THEN 'timeout' END,
    CASE WHEN page_id % 29 IN (1, 3) THEN 'localization' END,
    CASE WHEN page_id % 13 = 0 THEN 'user_agent' END,
    CASE WHEN page_id % 8 = 0 THEN 'rate_limit' END,
    CASE WHEN page_id % 10 = 0 THEN 'retry_times' END,
    CASE WHEN page_id % 12 = 0 THEN 'unknown field colour' END,
    CASE WHEN page_id % 19 = 4 THEN 'wordlists' WHEN page_id % 4 = 0 THEN 'wordlists missing' WHEN page_id % 4 = 3 THEN 'wordlist not found' END
    ], lambda r: r IS NOT NULL) END) AS rule
FROM hosted_pages""",
)
ORACLES["url_canonical"] = f"""
SELECT page_id, {_crawl_form('url')} AS crawl_form, {_crawl_form('url')} AS parsed_form,
       {_dir_form('url')} AS dir_form, {_authority('url')} AS domain,
       regexp_replace(url, '[#?].*', '') AS bare
FROM pages"""
ORACLES["resolved_links"] = _with(
    "hosted_pages", "linked_pages", "hrefs", "resolved",
    select="SELECT page_id, pos, href, link AS absolute FROM resolved",
)
ORACLES["url_segments"] = _with(
    "hosted_pages",
    select="""
SELECT host, segment, count(*) AS n
FROM (SELECT host, regexp_extract(bare, '^[a-z]+://[^/]*/+([^/]+)', 1) AS segment FROM hosted_pages) s
WHERE segment <> '' GROUP BY host, segment""",
)
ORACLES["internal_links"] = _with(*_LINKS, select="SELECT page_id, pos, link FROM internal")
ORACLES["parsed_pages"] = _with(
    *_PARSED,
    select=f"""
SELECT p.page_id, trim({_decoded("regexp_extract(p.html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
       CAST(count(l.link) AS INTEGER) AS n_links
FROM linked_pages p LEFT JOIN parsed_links l ON l.page_id = p.page_id GROUP BY p.page_id, p.html""",
)
_UNTAGGED = """regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<!doctype[^>]*>|<(?:script|style|noscript|template)[^>]*>.*?</(?:script|style|noscript|template)\\s*>',
    chr(1), 'g'), '<[^>]*>', chr(1), 'g')"""
ORACLES["page_text"] = f"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split(flat, chr(1)),
           lambda t: trim(t, concat(' ', chr(9), chr(10), chr(13)))), lambda t: t <> ''), ' ') AS text
FROM (SELECT page_id, {_decoded(_UNTAGGED)} AS flat FROM pages) f"""
ORACLES["same_host_links"] = _with(
    *_PARSED,
    select=f"SELECT page_id, pos, link FROM parsed_ranked WHERE {_authority('link')} = host",
)
ORACLES["raw_hrefs"] = _with(
    "hosted_pages",
    "linked_pages",
    select="""
SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS href
FROM (SELECT page_id, list_filter(regexp_extract_all(html, '(?i)href=[''"](.*?)[''"]', 1),
                                  lambda h: h <> '') AS l FROM linked_pages) x""",
)
_HEADING = "regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g')"
ORACLES["page_metadata"] = f"""
SELECT page_id, regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS html_lang,
       CAST(len(regexp_extract_all(html, '(?i)<meta\\s[^>]*(?:name|property)=')) AS INTEGER) AS n_meta,
       trim({_decoded(_HEADING)}) AS h1
FROM pages"""
# As the given pages have them: headings of one level, no named meta tags.
ORACLES["parsed_page_values"] = _with(
    *_PARSED,
    select=f"""
SELECT p.page_id, trim({_decoded("regexp_extract(p.html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title,
       regexp_extract(p.html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS html_lang,
       coalesce(string_agg(l.link, ' ' ORDER BY l.pos), '') AS links,
       CASE WHEN p.h1 = '' THEN '{{}}' ELSE '{{"h1":[' || CAST(to_json(p.h1) AS VARCHAR) || ']}}' END AS headings, '{{}}' AS meta
FROM (SELECT *, trim({_decoded(_HEADING)}) AS h1 FROM linked_pages) p
LEFT JOIN parsed_ranked l ON l.page_id = p.page_id GROUP BY p.page_id, p.html, p.h1""",
)
ORACLES["document_links"] = _with(
    *_PARSED,
    select=f"SELECT url AS source_page, link AS url, true AS is_document FROM parsed_links WHERE {_DOCUMENT}",
)
ORACLES["robots_admission"] = _with(
    *_VERDICTS, select="SELECT page_id, pos, link, allowed FROM verdicts"
)
ORACLES["hidden_resources"] = _with(*_HIDDEN, select="SELECT base, url, status FROM hidden")
ORACLES["broken_links"] = _with(
    *_LINKS,
    "snapshot",
    select="""
SELECT host, norm AS url, count(DISTINCT page_id) AS n_referrers
FROM internal WHERE norm NOT IN (SELECT norm FROM snapshot) GROUP BY host, norm""",
)
ORACLES["stable_dedup"] = _with(
    *_LINKS,
    select="""
SELECT host, link AS url, page_id AS first_page, pos AS first_pos
FROM (SELECT *, row_number() OVER (PARTITION BY host, link ORDER BY page_id, pos) AS rn FROM internal) r
WHERE rn = 1""",
)
ORACLES["distinct_links"] = _with(*_LINKS, select="SELECT DISTINCT host, norm AS url FROM internal")
ORACLES["stream_new_links"] = ORACLES["distinct_links"]
ORACLES["duplicate_counts"] = _with(
    *_LINKS,
    select="""
SELECT host, count(*) AS total, count(*) - count(DISTINCT link) AS removed FROM internal GROUP BY host""",
)
ORACLES["crawl_reachable"] = _with(
    *_VERDICTS,
    "sites",
    "snapshot",
    "edges",
    recursive=True,
    select=f""", reached(host, depth, url, max_depth) AS (
  SELECT host, 0, {_crawl_form('base_url')}, max_depth FROM sites
  UNION
  SELECT r.host, r.depth + 1, e.dst, r.max_depth
  FROM reached r JOIN edges e ON e.host = r.host AND e.src = r.url WHERE r.depth < r.max_depth)
SELECT host, CAST(min(depth) AS INTEGER) AS depth, url
FROM reached WHERE url IN (SELECT norm FROM snapshot) GROUP BY host, url""",
)
_WALK = f""", reached(host, depth, url, max_depth) AS (
  SELECT host, 0, {_crawl_form('base_url')}, max_depth FROM sites
  UNION
  SELECT r.host, r.depth + 1, e.dst, r.max_depth
  FROM reached r JOIN edges e ON e.host = r.host AND e.src = r.url WHERE r.depth < r.max_depth)
"""
_REACHED = _WALK.rstrip() + """,
scanned AS (SELECT DISTINCT r.host, s.page_id FROM reached r JOIN snapshot s ON s.norm = r.url)
"""
ORACLES["crawl_misses"] = _with(
    *_VERDICTS,
    "sites",
    "snapshot",
    "edges",
    recursive=True,
    select=_WALK
    + """SELECT host, CAST(min(depth) AS INTEGER) AS depth, url
FROM reached WHERE url NOT IN (SELECT norm FROM snapshot) GROUP BY host, url""",
)


def _budget_level(depth: int) -> str:
    """One level of a budgeted crawl: new targets in order, and those that there is room for."""
    before = " UNION ALL ".join(f"SELECT host, norm FROM level{d}" for d in range(depth))
    return f""",
next{depth} AS (
  SELECT f.host, e.dst AS norm, min([f.rank, e.pos]) AS place, f.max_pages, f.max_depth, f.seen
  FROM level{depth - 1} f JOIN edges e ON e.host = f.host AND e.src = f.norm
  WHERE f.max_depth >= {depth} AND (f.host, e.dst) NOT IN ({before})
  GROUP BY f.host, e.dst, f.max_pages, f.max_depth, f.seen),
level{depth} AS (
  SELECT host, norm, row_number() OVER (PARTITION BY host ORDER BY place) AS rank, max_pages, max_depth,
         seen + least(count(*) OVER (PARTITION BY host), ceil((max_pages - seen) / 2)) AS seen
  FROM next{depth}
  QUALIFY row_number() OVER (PARTITION BY host ORDER BY place) <= ceil((max_pages - seen) / 2))"""


def _budget_crawl(max_pages: str, max_depth: str, sound: str = "true") -> str:
    return _with(
        *_VERDICTS,
        "snapshot",
        "edges",
        select=f""", level0 AS (
  SELECT host, {_crawl_form('bare')} AS norm, CAST(1 AS BIGINT) AS rank, {max_pages} AS max_pages,
         {max_depth} AS max_depth, CAST(1 AS DOUBLE) AS seen
  FROM hosted_pages WHERE k = 1 AND {sound})"""
        + "".join(map(_budget_level, (1, 2, 3)))
        + "\n"
        + " UNION ALL ".join(
            f"SELECT host, CAST({d} AS INTEGER) AS depth, norm AS url FROM level{d}"
            " WHERE norm IN (SELECT norm FROM snapshot)"
            for d in range(4)
        ),
    )


ORACLES["crawl_budget"] = _budget_crawl("8 + 16 * (page_id % 5)", "3")
ORACLES["requested_crawl"] = _budget_crawl(
    "CASE WHEN page_id % 6 = 1 THEN 50 ELSE 1000 END",
    "CASE WHEN page_id % 7 = 1 THEN 2 ELSE 3 END",
    """page_id % 17 NOT IN (3, 5, 7) AND page_id % 11 NOT IN (0, 1) AND page_id % 7 <> 0 AND page_id % 6 <> 0
    AND page_id % 23 <> 2 AND page_id % 9 <> 0 AND page_id % 29 NOT IN (1, 3) AND page_id % 13 <> 0
    AND page_id % 8 <> 0 AND page_id % 10 <> 0 AND page_id % 12 <> 0 AND page_id % 19 <> 4
    AND page_id % 4 IN (1, 2)""",
)
ORACLES["localized_urls"] = _with(
    "hosted_pages",
    "linked_pages",
    select=f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INTEGER) AS pos,
       {_dir_form('href')} AS url
FROM (SELECT page_id, host, generate_subscripts(l, 1) AS place, unnest(l) AS href
      FROM (SELECT page_id, host, regexp_extract_all(html, '(?i)href=[''"](.*?)[''"]', 1) AS l
            FROM linked_pages) x) h
WHERE regexp_matches(href, '^https?://') AND {_authority('href')} = host""",
)
ORACLES["page_locales"] = _with(
    "hosted_pages", "locale_rules", "located", select="SELECT page_id, lang FROM located"
)

_CTE["report_entries"] = """
SELECT p.page_id, p.host, p.k, p.url, count(l.link) AS n_links, p.html
FROM linked_pages p LEFT JOIN parsed_links l ON l.page_id = p.page_id GROUP BY ALL"""
_CTE["report_docs"] = f"""
SELECT l.host, regexp_extract(l.link, '[^/]*$') AS name, l.link AS url,
       coalesce(r.size, 0) AS size, 'application/pdf' AS mime
FROM parsed_links l
LEFT JOIN (SELECT url, max(size) AS size FROM responses GROUP BY url) r ON r.url = l.link
WHERE {_DOCUMENT}"""

ORACLES["report_pages"] = _with(
    *_PARSED,
    "report_entries",
    select="""
SELECT host, url, CAST(n_links AS INTEGER) AS n_links,
       CAST(len(regexp_extract_all(html, '(?i)<meta\\s[^>]*(?:name|property)=')) AS INTEGER) AS n_meta,
       CAST(len(list_distinct(regexp_extract_all(html, '(?i)<(h[1-6])[\\s>]', 1))) AS INTEGER) AS n_headings,
       CAST(0 AS INTEGER) AS n_headers
FROM report_entries""",
)
ORACLES["report_documents"] = _with(
    *_PARSED, "responses", "report_docs", select="SELECT * FROM report_docs"
)
ORACLES["report_hidden"] = _with(
    *_HIDDEN,
    select=f"SELECT {_authority('base')} AS host, url, status, content_type AS type, size FROM hidden",
)
ORACLES["report_locales"] = _with(
    "hosted_pages",
    "locale_rules",
    "located",
    select="""
SELECT host, lang, row_number() OVER (PARTITION BY host, lang ORDER BY url) AS pos, url FROM located""",
)
_ALL = tuple(dict.fromkeys(
    _PARSED + ("report_entries", "responses", "report_docs") + _HIDDEN + ("locale_rules", "located", "sites")
))
ORACLES["site_report"] = _with(
    *_ALL,
    select=f"""
SELECT s.host,
       (SELECT count(*) FROM report_entries e WHERE e.host = s.host) AS n_pages,
       (SELECT count(*) FROM report_docs d WHERE d.host = s.host) AS n_documents,
       (SELECT count(*) FROM hidden h WHERE {_authority('h.base')} = s.host) AS n_hidden,
       (SELECT count(*) FROM located l WHERE l.host = s.host) AS n_locale_urls
FROM sites s""",
)
# The documents and locales of a scan are those of its pages' canonical URLs.
ORACLES["scan_report"] = _with(
    *dict.fromkeys(
        _VERDICTS + ("sites", "snapshot", "edges", "parsed_links", "locale_rules", "located") + _HIDDEN
    ),
    recursive=True,
    select=_REACHED
    + f"""SELECT s.host,
       (SELECT count(*) FROM scanned p WHERE p.host = s.host) AS n_pages,
       (SELECT count(*) FROM parsed_links l JOIN scanned p ON p.page_id = l.page_id
        WHERE p.host = s.host AND {_DOCUMENT}) AS n_documents,
       (SELECT count(*) FROM hidden h WHERE h.base = regexp_extract(s.base_url, '^[a-z]+://[^/]*'))
           AS n_hidden,
       (SELECT count(*) FROM located l JOIN scanned p ON p.page_id = l.page_id
        WHERE p.host = s.host) AS n_locale_urls
FROM sites s""",
)
_CTE["report_rows"] = f"""
SELECT host, 'site' AS section, 0 AS seq, NULL AS url, NULL AS n_links, NULL AS size, NULL AS kind, NULL AS status
FROM sites
UNION ALL SELECT host, 'pages', k, url, n_links, NULL, NULL, NULL FROM report_entries
UNION ALL
SELECT l.host, 'documents', row_number() OVER (PARTITION BY l.host ORDER BY h.k, l.pos), l.link, NULL,
       coalesce(r.size, 0), 'application/pdf', NULL
FROM parsed_ranked l JOIN hosted_pages h ON h.page_id = l.page_id
LEFT JOIN (SELECT url, max(size) AS size FROM responses GROUP BY url) r ON r.url = l.link
WHERE {_DOCUMENT}
UNION ALL
SELECT {_authority('base')}, 'hidden_resources',
       row_number() OVER (PARTITION BY {_authority('base')} ORDER BY url, status), url, NULL, size, content_type, status
FROM hidden
UNION ALL
SELECT host, 'locales', row_number() OVER (PARTITION BY host, lang ORDER BY url), url, NULL, NULL, lang, NULL
FROM located"""
ORACLES["site_report_json"] = _with(
    *_ALL,
    "report_rows",
    select="""
SELECT host, section, CAST(seq AS BIGINT) AS seq, url, CAST(n_links AS INTEGER) AS n_links,
       CAST(size AS BIGINT) AS size, kind, CAST(status AS INTEGER) AS status
FROM report_rows""",
)
ORACLES["loaded_documents"] = ORACLES["site_report_json"]


def _quoted(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


def _line(indent: int, *parts: str) -> str:
    """A line of a document: a line break, the indent, then SQL texts."""
    return " || ".join([f"chr(10) || '{' ' * indent}'", *parts])


def _pretty_fields(**fields: str) -> str:
    lines = [_line(6, f"""'"{k}": ' || {v}""") for k, v in fields.items()]
    return "'    {' || " + " || ',' || ".join(lines) + " || " + _line(4, "'}'")


# Fixed here, as the given pages have them: no named meta tags, headings of one level.
_CTE["document_entries"] = f"""
SELECT e.host, 1 AS section_no, '' AS lang, e.k AS seq,
       {_pretty_fields(
           url=_quoted("e.url"),
           links=f"""CASE WHEN l.links IS NULL THEN '[]' ELSE '[' || {_line(8, f"array_to_string(list_transform(l.links, lambda x: {_quoted('x')}), ',' || chr(10) || '        ')")} || {_line(6, "']'")} END""",
           meta="'{}'",
           headings=f"""CASE WHEN e.h1 = '' THEN '{{}}' ELSE '{{' || {_line(8, f"""'"h1": ['""")} || {_line(10, _quoted("e.h1"))} || {_line(8, "']'")} || {_line(6, "'}'")} END""",
           headers="'{}'",
       )} AS pretty,
       '{{"url":' || {_quoted("e.url")} || ',"links":' || coalesce(CAST(to_json(l.links) AS VARCHAR), '[]')
       || ',"meta":{{}},"headings":' || CASE WHEN e.h1 = '' THEN '{{}}' ELSE '{{"h1":[' || {_quoted("e.h1")} || ']}}' END
       || ',"headers":{{}}}}' AS compact
FROM (SELECT *, trim({_decoded(_HEADING)}) AS h1 FROM report_entries r) e
LEFT JOIN (SELECT page_id, list(link ORDER BY pos) AS links FROM parsed_ranked GROUP BY page_id) l ON l.page_id = e.page_id
UNION ALL
SELECT host, 2, '', seq,
       {_pretty_fields(name=_quoted("regexp_extract(url, '[^/]*$')"), url=_quoted("url"), size="CAST(size AS VARCHAR)", mime=_quoted("kind"))},
       '{{"name":' || {_quoted("regexp_extract(url, '[^/]*$')")} || ',"url":' || {_quoted("url")} || ',"size":' || CAST(size AS VARCHAR)
       || ',"mime":' || {_quoted("kind")} || '}}'
FROM report_rows WHERE section = 'documents'
UNION ALL
SELECT host, 3, '', seq,
       {_pretty_fields(url=_quoted("url"), status="CAST(status AS VARCHAR)", type=_quoted("kind"), size="CAST(size AS VARCHAR)")},
       '{{"url":' || {_quoted("url")} || ',"status":' || CAST(status AS VARCHAR) || ',"type":' || {_quoted("kind")}
       || ',"size":' || CAST(size AS VARCHAR) || '}}'
FROM report_rows WHERE section = 'hidden_resources'
UNION ALL
SELECT host, 4, kind, seq, '      ' || {_quoted("url")}, {_quoted("url")} FROM report_rows WHERE section = 'locales'"""


def _documents(layout: str) -> str:
    pad, gap = ("  ", ": ") if layout == "pretty" else ("", ":")
    return _with(
        *_ALL,
        "report_rows",
        "document_entries",
        select=f""",
headings AS (SELECT * FROM (VALUES (1, 'pages'), (2, 'documents'), (3, 'hidden_resources'), (4, 'locales')) t(section_no, name)),
pieces AS (
  SELECT host, section_no, lang, 1 AS part, seq, {layout} || CASE WHEN seq < max(seq) OVER (PARTITION BY host, section_no, lang)
         THEN ',' ELSE '' END AS text FROM document_entries
  UNION ALL SELECT host, 0, '', 0, 0, '{{' FROM sites
  UNION ALL SELECT s.host, h.section_no, '', CASE h.section_no WHEN 4 THEN -1 ELSE 0 END, 0,
         '{pad}"' || h.name || '"{gap}' || CASE h.section_no WHEN 4 THEN '{{' ELSE '[' END
         || CASE WHEN (s.host, h.section_no) IN (SELECT host, section_no FROM document_entries) THEN ''
                 WHEN h.section_no = 4 THEN '}}' ELSE '],' END
  FROM sites s CROSS JOIN headings h
  UNION ALL SELECT DISTINCT host, section_no, '', 2, 0, '{pad}],' FROM document_entries WHERE section_no < 4
  UNION ALL SELECT DISTINCT host, 4, lang, 0, 0, '{pad * 2}' || {_quoted("lang")} || '{gap}[' FROM document_entries WHERE section_no = 4
  UNION ALL SELECT host, 4, lang, 2, 0, '{pad * 2}]' || CASE WHEN lang < max(lang) OVER (PARTITION BY host) THEN ',' ELSE '' END
  FROM (SELECT DISTINCT host, lang FROM document_entries WHERE section_no = 4) l
  UNION ALL SELECT DISTINCT host, 5, '', 0, 0, '{pad}}}' FROM document_entries WHERE section_no = 4
  UNION ALL SELECT host, 5, '', 2, 0, '}}' FROM sites)
SELECT host, row_number() OVER (PARTITION BY host ORDER BY section_no, lang, part, seq) AS place, text FROM pieces""",
    )


ORACLES["site_documents"] = _documents("pretty")
ORACLES["site_documents_compact"] = _documents("compact")
_SECTION_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE section = '{x}') AS n_{x}" for x in ("pages", "documents", "hidden_resources", "locales")
)
ORACLES["report_roundtrip"] = _with(
    *_ALL,
    "report_rows",
    select=f"""
SELECT host, {_SECTION_COUNTS}, CAST(coalesce(sum(n_links), 0) AS BIGINT) AS n_links,
       CAST(coalesce(sum(size) FILTER (WHERE section = 'documents'), 0) AS BIGINT) AS document_bytes,
       CAST(coalesce(sum(size) FILTER (WHERE section = 'hidden_resources'), 0) AS BIGINT) AS hidden_bytes,
       max(url) FILTER (WHERE section = 'locales') AS last_locale_url
FROM report_rows GROUP BY host""",
)
ORACLES["last_entry_locales"] = _with(
    "hosted_pages",
    "locale_rules",
    "located",
    select="""
SELECT host, lang, url AS urls FROM located
WHERE page_id IN (SELECT max(page_id) FROM hosted_pages GROUP BY host)""",
)
ORACLES["rate_audit"] = """
SELECT user_id AS site, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
GROUP BY 1, 2 HAVING count(*) > 3"""

_CTE["named"] = """
SELECT DISTINCT i.page_id, i.host, i.norm AS url, unnest(CASE WHEN i.page_id % 3 = 0 THEN [0, 40] ELSE [0] END) AS again
FROM internal i"""
_CTE["mentions"] = """
SELECT host, url, TIMESTAMP '2024-01-01' + to_minutes(15 * (page_id * 37 % 960 + again)) AS ts FROM named"""
ORACLES["stream_recent_links"] = _with(
    *_LINKS,
    "named",
    "mentions",
    select="""
, gaps AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '3 hours 7 minutes' THEN 0 ELSE 1 END AS fresh
  FROM mentions WINDOW w AS (PARTITION BY host, url ORDER BY ts)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY host, url ORDER BY ts) AS run FROM gaps)
SELECT host, url, min(ts) AS first_seen, count(*) AS n FROM runs GROUP BY host, url, run
HAVING max(ts) + INTERVAL '3 hours 7 minutes' <= (SELECT max(ts) FROM mentions) - INTERVAL '3 days 1 minute'""",
)
ORACLES["stream_due_retries"] = _with(
    "attempts",
    select="""
, timed AS (
  SELECT url, attempt, ts, lead(ts) OVER (PARTITION BY url ORDER BY ts, attempt) AS next_ts,
         ts + to_hours(CAST(least(pow(2, attempt), 60) AS INTEGER)) AS due,
         coalesce(status IN (0, 429) OR status BETWEEN 500 AND 599, false) AND attempt <= 3 AS retried
  FROM attempts)
SELECT url, attempt, due FROM timed
WHERE retried AND (next_ts IS NULL OR next_ts > due)
  AND due <= (SELECT least(max(ts), max(due) FILTER (WHERE retried)) FROM timed) - INTERVAL 8 DAY""",
)
ORACLES["rate_bursts"] = """
SELECT DISTINCT user_id AS site, ts, n
FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
             RANGE BETWEEN INTERVAL '5 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW) AS n FROM events) e
WHERE n > 2"""
_LANGUAGE_RANGE = "^\\s*([a-z0-9*]{1,8}(?:-[a-z0-9*]{1,8})*)\\s*(?:;\\s*q\\s*=\\s*([0-9.]+)\\s*)?$"
ORACLES["request_locales"] = _with(
    "locale_rules",
    select=f"""
, headers AS (
  SELECT event_id, CASE event_id % 9
      WHEN 0 THEN 'de-CH-1996;q=0.7, en;q=0.9, fr;q=0.8' WHEN 1 THEN 'es' WHEN 2 THEN '*, ja-JP ; q=0.2'
      WHEN 3 THEN 'de;q=0, zh-Hant-x-y;q=0.5' WHEN 4 THEN '' WHEN 5 THEN 'KO-kr;q=0.4,fr-FR;q=0.4'
      WHEN 6 THEN 'fr;q=high, de;q=0.1' WHEN 7 THEN 'en-GB,en' END AS header
  FROM events),
items AS (
  SELECT event_id, generate_subscripts(l, 1) AS pos, unnest(l) AS item
  FROM (SELECT event_id, string_split(lower(header), ',') AS l FROM headers) h),
ranges AS (
  SELECT event_id, pos, string_split(regexp_extract(item, '{_LANGUAGE_RANGE}', 1), '-') AS parts,
         coalesce(TRY_CAST(nullif(regexp_extract(item, '{_LANGUAGE_RANGE}', 2), '') AS DOUBLE), 1) AS weight
  FROM items WHERE regexp_matches(item, '{_LANGUAGE_RANGE}')),
cuts AS (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM ranges),
tags AS (SELECT lang, lower(unnest(tags)) AS tag FROM locale_rules),
found AS (
  SELECT c.event_id, c.pos, c.weight, arg_max(t.lang, c.n) AS lang
  FROM cuts c JOIN tags t ON t.tag = array_to_string(c.parts[1:c.n], '-')
  WHERE c.weight > 0 AND (c.n = len(c.parts) OR length(c.parts[c.n]) > 1) GROUP BY ALL),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, pos) = 1)
SELECT e.event_id, b.lang FROM events e LEFT JOIN best b ON b.event_id = e.event_id""",
)
