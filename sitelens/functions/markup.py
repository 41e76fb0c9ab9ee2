"""Text, titles, headings and tag facts of plain markup, read in the JVM.

Markup is plain here if it is a sequence of well-formed tokens and nothing else, if no
attribute value holds an angle bracket, and if no element but scripts and styles hides
its text. Then comments, declarations and raw text can be cut out by one pattern, every
``<`` before a letter or slash is a tag, and what lies between tags is text. Each field has
a test of its own for what only a tokenizer with a stack gets right: a title or heading
that is more than text with simple inline elements, character references beyond the
common ones, attributes without a value, repeated keys. Where a test fails, the field is
NULL and the page goes to the tokenizer as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import DataFrame, functions as F

from sitelens.functions import html as tokenizer
from sitelens.functions.sql import each, keep, let, raw, struct, text

_WS = tokenizer._WS
_VALUE = rf"(?:\x22[^\x22<>]*+\x22|\x27[^\x27<>]*+\x27|{tokenizer._BARE_VALUE})"
_ATTRIBUTES = rf"(?:{_WS}++{tokenizer._NAME}(?:{_WS}*+={_WS}*+{_VALUE})?+)*+{_WS}*+"
_END = rf"(?=[ \t\r\n\f/>])"
# Cut out as a whole: what is neither a tag nor text.
_ASIDE = (
    r"<(?:!(?:--[^\-]*+(?:-[^\-]++)*+-->|(?i:doctype)[^>]*+>)|\?[^>]*+>|(?=[sS])(?:"
    + "|".join(tokenizer._RAW_BODY.replace("NAME", n).replace("ATTRS", _ATTRIBUTES) for n in ("script", "style"))
    + "))"
)
_PLAIN = (
    rf"^(?:[^<]++|{_ASIDE}"
    rf"|</(?!(?i:noscript|template|rt|rp)[ \t\r\n\f>])[A-Za-z][A-Za-z0-9_:.\-]*+{_WS}*+>"
    r"|<(?=[^A-Za-z/!?])"
    rf"|<(?!(?i:script|style|noscript|template|rt|rp){_END})[A-Za-z][A-Za-z0-9_:.\-]*+{_ATTRIBUTES}/?+>)*+\z"
)
_ANY_TAG = r"<[A-Za-z/!][^<>]*+>"

# Fixed value: the characters that Python's str.strip() removes.
_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# The references that are decoded here; all others are the tokenizer's.
_NAMES = (
    "lt gt quot apos nbsp copy reg middot bull hellip ndash mdash lsquo rsquo ldquo rdquo laquo raquo euro trade "
    "times deg eacute egrave agrave ccedil auml ouml uuml szlig ntilde"
).split()
_OTHER_REFERENCE = rf"&(?!(?:amp|{'|'.join(_NAMES)});)[A-Za-z#]"

_INLINE = rf"[^<]*+(?:(?:<(?i:br|img){_ATTRIBUTES}/?+>|<([A-Za-z][A-Za-z0-9_:.\-]*+){_ATTRIBUTES}>[^<]*+</\2{_WS}*+>)[^<]*+)*+"
_HEADING = rf"(?i)<(h[1-6]){_ATTRIBUTES}>(?:(?!</?h[1-6]{_END}|</?title{_END}){_INLINE})</\1{_WS}*+>"
_HEADING_TAG = rf"(?i)</?h[1-6]{_END}"
_TITLE_TAG = rf"(?i)<title{_END}"
_TITLE = rf"(?i)^<title{_ATTRIBUTES}>([^<]*+)</title{_WS}*+>"


def _decoded(value: str) -> str:
    chain = value
    for name in _NAMES:
        chain = f"replace({chain}, '&{name};', {text(html5[name + ';'])})"
    return f"if(instr({value}, '&') = 0, {value}, replace({chain}, '&amp;', '&'))"


def _clear(value: str) -> str:
    """Whether all references of a text are decoded here."""
    return f"NOT {value} RLIKE {raw(_OTHER_REFERENCE)}"


def _stripped(value: str) -> str:
    return f"trim(BOTH {text(_SPACE)} FROM {value})"


def _nodes(markup: str) -> str:
    return f"split({markup}, {raw(_ANY_TAG)})"


def _clear_nodes(nodes: str) -> str:
    return f"forall({nodes}, n -> instr(n, '&') = 0 OR {_clear('n')})"


def _joined(nodes: str) -> str:
    """Text nodes in order, decoded and stripped, empty ones dropped, with blanks between."""
    pieces = each(nodes, lambda n: _stripped(_decoded(n)))
    return f"array_join({keep(pieces, lambda n: f"{n} <> ''")}, ' ')"


def _text(clean: str) -> str:
    return let(_nodes(clean), lambda n: f"if({_clear_nodes(n)}, {_joined(n)}, NULL)")


def _title(clean: str) -> str:
    def of(rest: str) -> str:
        found = f"regexp_extract({rest}, {raw(_TITLE)}, 1)"
        simple = f"{rest} RLIKE {raw(_TITLE)} AND {_clear(found)}"
        return f"CASE WHEN {rest} = '' THEN '' WHEN {simple} THEN {_stripped(_decoded(found))} END"

    at = f"regexp_instr({clean}, {raw(_TITLE_TAG)})"
    return let(at, lambda i: let(f"if({i} = 0, '', substr({clean}, {i}))", of))


def _headings(clean: str) -> str:
    def of(found: str) -> str:
        levels = f"array_distinct({each(found, lambda h: f'{h}.level')})"
        texts = lambda l: each(keep(found, lambda h: f"{h}.level = {l}"), lambda h: f"{h}.heading")
        return f"map_from_arrays({levels}, {each(levels, texts)})"

    def read(found: str) -> str:
        entries = each(found, lambda h: struct(level=f"{h}.level", heading=_joined(f"{h}.nodes")))
        tags = f"size(regexp_extract_all({clean}, {raw(_HEADING_TAG)}, 0))"
        clear = f"forall({found}, h -> {_clear_nodes('h.nodes')})"
        return f"if({tags} = 2 * size({found}) AND {clear}, {let(entries, of)}, NULL)"

    whole = f"regexp_extract_all({clean}, {raw(_HEADING)}, 0)"
    cut = each(whole, lambda h: struct(level=f"lower(substr({h}, 2, 2))", nodes=_nodes(h)))
    return let(cut, read)


def _tags(clean: str, name: str) -> str:
    """Attribute texts of the start tags of a name."""
    return f"regexp_extract_all({clean}, {raw(rf'(?i)<{name}({_ATTRIBUTES})/?+>')}, 1)"


def _attribute(attributes: str, name: str) -> str:
    """The last value of an attribute, NULL if it has none."""
    pattern = rf"(?i){_WS}++{name}(?:{_WS}*+={_WS}*+({_VALUE}))|{_WS}++{tokenizer._NAME}(?:{_WS}*+={_WS}*+{_VALUE})?+"
    given = keep(f"regexp_extract_all({attributes}, {raw(pattern)}, 1)", lambda v: f"{v} <> ''")
    return f"regexp_replace(try_element_at({given}, -1), {raw(tokenizer._QUOTES)}, '')"


def _unclear(attributes: str, *names: str) -> str:
    """Whether a value needs decoding or one of the attributes stands without a value."""
    bare = rf"(?i){_WS}(?:{'|'.join(names)})(?!{_WS}*+=)(?![A-Za-z0-9_:.@\-])"
    return f"(instr({attributes}, '&') > 0 OR {attributes} RLIKE {raw(bare)})"


def _meta(clean: str) -> str:
    def read(tags: str) -> str:
        named = each(
            tags,
            lambda t: struct(
                key=f"coalesce(nullif({_attribute(t, 'name')}, ''), nullif({_attribute(t, 'property')}, ''))",
                value=_attribute(t, "content"),
            ),
        )
        kept = keep(named, lambda m: f"{m}.key IS NOT NULL AND {m}.value IS NOT NULL")

        def of(entries: str) -> str:
            keys = each(entries, lambda m: f"{m}.key")
            single = f"size(array_distinct({keys})) = size({entries})"
            return f"if({single}, map_from_arrays({keys}, {each(entries, lambda m: f'{m}.value')}), NULL)"

        unclear = f"exists({tags}, t -> {_unclear('t', 'name', 'property', 'content')})"
        return f"if({unclear}, NULL, {let(kept, of)})"

    return let(_tags(clean, "meta"), read)


def _html_lang(clean: str) -> str:
    """Empty text for none, as NULL stands for the tokenizer."""

    def read(tags: str) -> str:
        values = f"array_compact({each(tags, lambda t: _attribute(t, 'lang'))})"
        return f"if(exists({tags}, t -> {_unclear('t', 'lang')}), NULL, struct(try_element_at({values}, 1) AS value))"

    return let(_tags(clean, "html"), read)


def _hreflangs(clean: str) -> str:
    def read(tags: str) -> str:
        values = each(tags, lambda t: _attribute(t, "hreflang"))
        given = keep(values, lambda v: f"coalesce({v}, '') <> ''")
        return f"if(exists({tags}, t -> {_unclear('t', 'hreflang')}), NULL, {given})"

    return let(_tags(clean, "link"), read)


def _hrefs(clean: str) -> str:
    return let(keep(_tags(clean, "a"), lambda t: f"{t} <> ''"), tokenizer.link_values)


_READERS = {
    "hrefs": _hrefs,
    "title": _title,
    "text": _text,
    "meta": _meta,
    "headings": _headings,
    "html_lang": _html_lang,
    "hreflangs": _hreflangs,
}


def native_fields(html: str, fields: Sequence[str]) -> str:
    """Struct of the fields of plain markup; NULL for markup that the tokenizer must read."""

    def read(clean: str) -> str:
        return struct(**{f: _READERS[f](clean) for f in fields})

    def checked(page: str) -> str:
        known = " AND ".join(f"{page}.{f} IS NOT NULL" for f in fields)
        values = {f: f"{page}.{f}.value" if f == "html_lang" else f"{page}.{f}" for f in fields}
        whole = f"cast({struct(**values)} AS {tokenizer.fields_type(fields)})"
        return f"if({known}, {whole}, NULL)"

    clean = f"if({html} RLIKE {raw(_PLAIN)}, regexp_replace({html}, {raw(_ASIDE)}, '<!>'), NULL)"
    return let(clean, lambda c: f"if({c} IS NULL, NULL, {let(read(c), checked)})")


def with_fields(pages: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Pages with ``page``, the struct of ``fields``, in place of ``html``.

    Plain markup is read in the JVM; only the text of other pages goes through the
    tokenizer, as NULL is sent for the rest.
    """
    fields = tuple(fields)
    others = [c for c in pages.columns if c != "html"]
    native = pages.withColumn("native_page", F.expr(native_fields("html", fields)))
    # ``rest`` is a column of its own, so that the markup is not carried past Python.
    split = native.selectExpr(*others, "native_page", "if(native_page IS NULL, html, NULL) AS rest")
    return split.withColumn("read", tokenizer.read_html(F.col("rest"), fields)).selectExpr(
        *others, "if(rest IS NULL, native_page, read) AS page"
    )
