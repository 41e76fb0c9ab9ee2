"""Scan requests: defaults and validation as a data-quality job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.functions.sql import keep, let, raw, texts
from sitelens.functions.urls import parse

# Request fields and their defaults (NULL where required or absent).
# The default agent is our own name.
DEFAULTS = {
    "base_url": None,
    "max_depth": "3",
    "max_pages": "1000",
    "timeout": "10.0",
    "user_agent": "SiteLensBot/1.0",
    "rate_limit": "1.0",
    "retry_times": "3",
    "wordlists": None,
    "localization": None,
}

_WHOLE = raw(r"^\s*[+-]?[0-9]+(?:\.0*)?\s*$")


def _whole(field: str) -> str:
    """The field as a whole number; NULL if it is none."""
    return f"if(raw.{field} RLIKE {_WHOLE}, cast(try_cast(raw.{field} AS decimal(38,3)) AS decimal(35,0)), NULL)"


def _number(field: str) -> str:
    return f"try_cast(raw.{field} AS double)"


def _fields(requests: DataFrame) -> DataFrame:
    """Request JSON as a map of raw field texts, kept next to the given columns."""
    named = ", ".join(f"'{f}', fields['{f}']" for f in DEFAULTS)
    return requests.selectExpr(
        "*", "from_json(request, 'map<string,string>') AS fields"
    ).selectExpr("*", f"named_struct({named}) AS raw")


def _given(field: str) -> str:
    """Whether the request names the field, be it with a JSON null."""
    return f"coalesce(map_contains_key(fields, '{field}'), false)"


def _bad(field: str, valid: str) -> str:
    return f"{_given(field)} AND NOT coalesce({valid}, false)"


_MAP = "map<string,string>"
# A locale needs both of its texts; its language lists must be lists.
_LOCALE = " AND ".join(
    [
        "e['subdomain'] IS NOT NULL",
        "e['path_prefix'] IS NOT NULL",
        *(
            f"(NOT map_contains_key(e, '{f}') OR from_json(e['{f}'], 'array<string>') IS NOT NULL)"
            for f in ("hreflangs", "accept_languages")
        ),
    ]
)


def violations(requests: DataFrame, catalogue: DataFrame, *keys: str) -> DataFrame:
    """One row per broken rule of each request.

    ``requests`` have ``request``, the JSON text; ``catalogue`` lists the ``path``
    of every stored wordlist. Text that is no JSON object breaks one rule, named so.
    """
    host_url = let(
        parse("raw.base_url"), lambda p: f"{p}.scheme IN ('http', 'https') AND {p}.authority <> ''"
    )
    lists = f"from_json(raw.wordlists, '{_MAP}')"
    locales = f"transform(map_values(from_json(raw.localization, '{_MAP}')), v -> from_json(v, '{_MAP}'))"
    rules = {
        "not a JSON object": "fields IS NULL",
        "base_url missing": f"fields IS NOT NULL AND NOT {_given('base_url')}",
        "base_url not http": _bad("base_url", host_url),
        "max_depth": _bad("max_depth", f"{_whole('max_depth')} >= 0"),
        "max_pages": _bad("max_pages", f"{_whole('max_pages')} >= 1"),
        "timeout": _bad("timeout", f"{_number('timeout')} > 0"),
        "user_agent": _bad("user_agent", "raw.user_agent <> ''"),
        "rate_limit": _bad("rate_limit", f"{_number('rate_limit')} > 0"),
        "retry_times": _bad("retry_times", f"{_whole('retry_times')} >= 0"),
        "wordlists missing": f"fields IS NOT NULL AND NOT {_given('wordlists')}",
        "wordlists": _bad("wordlists", f"NOT exists(map_values({lists}), v -> v IS NULL)"),
        "localization": _bad("localization", f"NOT exists({locales}, e -> NOT coalesce({_LOCALE}, false))"),
    }
    broken = ", ".join(f"if({test}, '{name}', NULL)" for name, test in rules.items())
    unknown = keep("coalesce(map_keys(fields), array())", lambda k: f"{k} NOT IN ({texts(DEFAULTS)})")
    parsed = _fields(requests)
    named = parsed.selectExpr(
        *keys,
        f"explode(concat(array_compact(array({broken})),"
        f" transform({unknown}, k -> 'unknown field ' || k))) AS rule",
    )
    listed = parsed.selectExpr(*keys, f"explode(map_values({lists})) AS path").filter("path IS NOT NULL")
    absent = listed.join(catalogue, "path", "left_anti").selectExpr(
        *keys, "'wordlist not found' AS rule"
    )
    return named.unionByName(absent.distinct())


def with_defaults(requests: DataFrame, *keys: str) -> DataFrame:
    """Typed request fields, defaults filled in. Run on requests without violations."""

    def value(field: str) -> str:
        return f"coalesce(raw.{field}, {texts([DEFAULTS[field]])})"

    def whole(field: str, kind: str) -> str:
        return f"cast(coalesce({_whole(field)}, {DEFAULTS[field]}) AS {kind}) AS {field}"

    return _fields(requests).selectExpr(
        "site",
        *keys,
        "raw.base_url AS base_url",
        whole("max_depth", "int"),
        whole("max_pages", "bigint"),
        f"cast({value('timeout')} AS double) AS timeout",
        f"{value('user_agent')} AS user_agent",
        f"cast({value('rate_limit')} AS double) AS rate_limit",
        whole("retry_times", "int"),
    )


def accepted(requests: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Requests that break no rule, typed; ``key`` names a column that tells requests apart."""
    bad = violations(requests, catalogue, key).select(key).distinct()
    return with_defaults(requests.join(bad, key, "left_anti"), key)
