"""URL functions as native SQL expressions.

Functions that read several components take the name of a struct made by
:func:`parse`, so a URL is split once however many forms are asked for; the
``*_of`` functions take a URL.
"""

from __future__ import annotations

import urllib.parse

from sitelens.functions.sql import each, keep, let, raw, struct, text

# RFC 3986, appendix B.
_RFC3986 = raw(
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
)
_BARE_PATH = raw(r"^(?!//)[^:?#;\x00-\x20]*+\z")
_LAST_PARAMS = raw(r"(?s);([^/]*)\z")
_DOT_SEGMENT = raw(r"(?s)(?:^|/)\.\.?(?:/|\z)")

# Document extensions.
DOCUMENT_PATTERN = r"\.(?:pdf|doc|docx|xls|xlsx|ppt|pptx)\z"

# Link schemes that are never followed, matched case-sensitively.
SKIPPED_SCHEMES = ("mailto:", "javascript:")


def _family(schemes: list[str]) -> str:
    return text(" ".join(["", *sorted(schemes), ""]))


# Scheme families of the standard URL syntax: which may carry ;params, an
# authority, and relative references.
_PARAMS = _family(urllib.parse.uses_params)
_NETLOC = _family([s for s in urllib.parse.uses_netloc if s])
_RELATIVE = _family(urllib.parse.uses_relative)


def _belongs(scheme: str, family: str) -> str:
    return f"contains({family}, concat(' ', {scheme}, ' '))"


def clean(url: str) -> str:
    """Drop leading control characters and spaces, and tabs and line ends anywhere."""
    return f"regexp_replace({url}, {raw('^[\\x00-\\x20]+|[\\t\\n\\r]')}, '')"


def _split(cleaned: str) -> str:
    part = [f"regexp_extract({cleaned}, {_RFC3986}, {i})" for i in range(1, 6)]
    return struct(
        scheme=f"lower({part[0]})",
        authority=part[1],
        path=part[2],
        query=part[3],
        fragment=part[4],
    )


def _cut_params(p: str) -> str:
    present = f"contains({p}.path, ';') AND {_belongs(f'{p}.scheme', _PARAMS)}"
    return struct(
        scheme=f"{p}.scheme",
        authority=f"{p}.authority",
        path=f"if({present}, regexp_replace({p}.path, {_LAST_PARAMS}, ''), {p}.path)",
        params=f"if({present}, regexp_extract({p}.path, {_LAST_PARAMS}, 1), '')",
        query=f"{p}.query",
        fragment=f"{p}.fragment",
    )


def _only_path(url: str) -> str:
    return struct(scheme="''", authority="''", path=url, params="''", query="''", fragment="''")


def is_rooted_path(url: str) -> str:
    """A path from the root and nothing else, without dot segments."""
    return f"(startswith({url}, '/') AND {url} RLIKE {_BARE_PATH} AND NOT contains({url}, '/.'))"


def parse_each(urls: str) -> str:
    """Array of part structs, one per URL of an array.

    Fields: scheme (lower-cased), authority, path, params, query, fragment;
    absent ones are empty. Bare paths, the most common links, take one match.
    """

    def parts(url: str) -> str:
        full = let(let(clean(url), _split), _cut_params)
        return f"if({url} RLIKE {_BARE_PATH}, {_only_path(url)}, {full})"

    return each(urls, parts)


def parse(url: str) -> str:
    """Part struct of one URL."""
    return f"element_at({parse_each(f'array({url})')}, 1)"


def _unsplit(scheme: str, authority: str, path: str) -> str:
    rooted = f"{path} = '' OR startswith({path}, '/')"
    hier = (
        f"CASE WHEN {authority} <> '' THEN"
        f" concat('//', {authority}, if({rooted}, '', '/'), {path})"
        f" WHEN startswith({path}, '//') THEN concat('//', {path})"
        f" WHEN {_belongs(scheme, _NETLOC)} AND ({rooted}) THEN concat('//', {path})"
        f" ELSE {path} END"
    )
    return f"concat({scheme}, if({scheme} = '', '', ':'), {hier})"


def _no_trailing_slash(path: str) -> str:
    return f"regexp_replace({path}, '/+$', '')"


def crawl_form(p: str) -> str:
    """Canonical form used to recognise visited pages; the root has no slash."""
    host = f"lower({p}.authority)"
    return let(
        _no_trailing_slash(f"{p}.path"),
        lambda path: (
            f"if({path} = '', concat({p}.scheme, '://', {host}),"
            f" {_unsplit(f'{p}.scheme', host, path)})"
        ),
    )


def parsed_form(p: str) -> str:
    """Canonical form of links in a parsed page; relative input stays relative."""
    return let(
        _no_trailing_slash(f"{p}.path"),
        lambda path: _unsplit(f"{p}.scheme", f"lower({p}.authority)", path),
    )


def directory_form(p: str) -> str:
    """Directory form: a path whose last component has no suffix ends in a slash."""
    named = f"regexp_replace({p}.path, {raw(r'(?:/+\.)+\z')}, '')"
    folder = (
        f"{p}.path <> '' AND NOT endswith({p}.path, '/')"
        f" AND NOT {named} RLIKE {raw(r'[^/]\.[^./]+\z')}"
    )
    return let(
        f"if({folder}, concat({p}.path, '/'), {p}.path)",
        lambda path: _unsplit(f"{p}.scheme", f"{p}.authority", path),
    )


def crawl_form_of(url: str) -> str:
    return let(parse(url), crawl_form)


def parsed_form_of(url: str) -> str:
    return let(parse(url), parsed_form)


def directory_form_of(url: str) -> str:
    return let(parse(url), directory_form)


def domain_of(url: str) -> str:
    """Authority of a URL, port and case kept."""
    return f"regexp_extract({clean(url)}, {_RFC3986}, 2)"


def site_root_of(url: str) -> str:
    """``scheme://authority`` of a URL."""
    return let(parse(url), lambda p: f"concat({p}.scheme, '://', {p}.authority)")


def bare_path(url: str) -> str:
    """Cut at the first ``#`` or ``?``, up to the end of the line."""
    return f"regexp_replace({url}, {raw('[#?][^\\n]*')}, '')"


def _remove_dot_segments(path: str) -> str:
    def closed(segments: str) -> str:
        kept = (
            f"aggregate({segments}, cast(array() AS array<string>), (acc, seg) -> CASE"
            " WHEN seg = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0))"
            " WHEN seg = '.' THEN acc ELSE concat(acc, array(seg)) END)"
        )
        tail = f"if(element_at({segments}, -1) IN ('.', '..'), array(''), array())"
        return f"array_join(concat({kept}, {tail}), '/')"

    return let(f"split({path}, '/')", closed)


def _merged_path(b: str, r: str) -> str:
    folder = f"if({b}.path = '', '/', regexp_replace({b}.path, {raw(r'[^/]*\z')}, ''))"
    joined = (
        f"if(startswith({r}.path, '/'), {r}.path,"
        f" regexp_replace(concat({folder}, {r}.path), '/{{2,}}', '/'))"
    )
    plain = let(
        joined,
        lambda path: (
            f"if(contains({path}, '.') AND {path} RLIKE {_DOT_SEGMENT},"
            f" {_remove_dot_segments(path)}, {path})"
        ),
    )
    return let(
        plain,
        lambda path: (
            f"CASE WHEN {path} = '' THEN '/'"
            f" WHEN {b}.authority <> '' AND NOT startswith({path}, '/') THEN concat('/', {path})"
            f" ELSE {path} END"
        ),
    )


def stands_alone(b: str, r: str) -> str:
    """A non-empty reference that is not merged with the base at all.

    It has another scheme, or the base takes no relative references or is empty.
    """
    everything = "scheme authority path params query fragment".split()
    no_base = " AND ".join(f"{b}.{f} = ''" for f in everything)
    some_ref = " OR ".join(f"{r}.{f} <> ''" for f in everything)
    return (
        f"(({r}.scheme <> '' AND {r}.scheme <> {b}.scheme)"
        f" OR NOT {_belongs(f'{b}.scheme', _RELATIVE)} OR ({no_base})) AND ({some_ref})"
    )


def resolve(b: str, r: str, alone: str) -> str:
    """Parts of reference ``r`` seen from base ``b``; ``alone`` is :func:`stands_alone`."""
    absolute = f"({alone} OR {r}.authority <> '')"
    inherits = f"(NOT {absolute} AND {r}.path = '' AND {r}.params = '')"
    whole = f"({inherits} AND {r}.query = '')"
    return struct(
        scheme=f"if({alone}, {r}.scheme, {b}.scheme)",
        authority=f"if({absolute}, {r}.authority, {b}.authority)",
        path=(
            f"CASE WHEN {absolute} THEN {r}.path WHEN {inherits} THEN {b}.path"
            f" ELSE {_merged_path(b, r)} END"
        ),
        params=f"if({inherits}, {b}.params, {r}.params)",
        query=f"if({whole}, {b}.query, {r}.query)",
        fragment=f"if({whole} AND {r}.fragment = '', {b}.fragment, {r}.fragment)",
    )


def assemble(p: str) -> str:
    """A URL as text from its parts."""
    path = f"concat({p}.path, if({p}.params = '', '', concat(';', {p}.params)))"
    return let(
        path,
        lambda full: (
            f"concat({_unsplit(f'{p}.scheme', f'{p}.authority', full)},"
            f" if({p}.query = '', '', concat('?', {p}.query)),"
            f" if({p}.fragment = '', '', concat('#', {p}.fragment)))"
        ),
    )


def in_domain(p: str, base_domain: str) -> str:
    """An http(s) URL whose authority is exactly ``base_domain``."""
    return f"({p}.scheme IN ('http', 'https') AND {p}.authority = {base_domain})"


def is_document(url: str) -> str:
    """The URL ends in a document extension; a query string defeats it."""
    return f"lower({url}) RLIKE {raw(DOCUMENT_PATTERN)}"


def is_followed(href: str) -> str:
    """Neither a mail address nor a script."""
    return " AND ".join(f"NOT startswith({href}, {text(s)})" for s in SKIPPED_SCHEMES)


def is_success(status: str) -> str:
    """HTTP success class."""
    return f"{status} BETWEEN 200 AND 299"


def first_segment(p: str) -> str:
    """First non-empty path segment, or NULL."""
    segments = keep(f"split({p}.path, '/')", lambda s: f"{s} <> ''")
    return f"try_element_at({segments}, 1)"
