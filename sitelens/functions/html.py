"""One Arrow pass over HTML, the only Python on the data path.

``read_html`` parses each page once with the standard library's tolerant
tokenizer and returns a struct of exactly the fields asked for, so a link job
moves no page text. Everything downstream is native columns.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from sitelens.functions.sql import each, keep, let, raw

# Executors get the tokenizer by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TYPES = {
    "hrefs": ("array<string>", pa.list_(pa.string())),
    "title": ("string", pa.string()),
    "text": ("string", pa.string()),
    "meta": ("map<string,string>", pa.map_(pa.string(), pa.string())),
    "headings": (
        "map<string,array<string>>",
        pa.map_(pa.string(), pa.list_(pa.string())),
    ),
    "html_lang": ("string", pa.string()),
    "hreflangs": ("array<string>", pa.list_(pa.string())),
}
FIELDS = tuple(_TYPES)
_TEXT_FIELDS = {"title", "text", "headings"}

# HTML void elements, subtrees that are not visible text (scripts and the
# readings beside ruby text), headings.
_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
_HIDDEN = frozenset(("script", "style", "noscript", "template", "rt", "rp"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _numeric_reference(name: str) -> str:
    try:
        code = int(name[1:], 16) if name[:1] in "xX" else int(name)
        if 128 <= code < 256:
            return bytes((code,)).decode("windows-1252", "replace").replace("�", chr(code))
        return chr(code)
    except (ValueError, OverflowError):
        return "�"


class _Attributes(HTMLParser):
    """Start-tag facts: links, meta tags and languages."""

    def __init__(self, convert_charrefs: bool = True) -> None:
        super().__init__(convert_charrefs=convert_charrefs)
        self.hrefs: list[str] = []
        self.meta: dict[str, str] = {}
        self.hreflangs: list[str] = []
        self.html_lang: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href", False)
            if href is not False:
                self.hrefs.append(href or "")
        elif tag == "meta":
            seen = dict(attrs)
            key = seen.get("name") or seen.get("property")
            if key and seen.get("content") is not None:
                self.meta[key] = seen["content"]
        elif tag == "link":
            lang = dict(attrs).get("hreflang")
            if lang:
                self.hreflangs.append(lang)
        elif tag == "html" and self.html_lang is None:
            self.html_lang = dict(attrs).get("lang")


class _Page(_Attributes):
    """Adds text nodes; an end tag closes every element opened inside it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[str] = []
        self.count: dict[str, int] = {}
        self.node: list[str] = []
        self.words: list[str] = []
        self.title: list[str] | None = None
        self.title_depth = -1
        self.headings: dict[str, list[str]] = {}
        self.heading: list[str] | None = None
        self.heading_depth = -1

    def flush(self) -> None:
        if not self.node:
            return
        piece = "".join(self.node).strip()
        self.node.clear()
        if not piece:
            return
        if self.title_depth >= 0:  # a title counts wherever it stands
            self.title.append(piece)
        if any(self.count.get(name) for name in _HIDDEN):
            return
        self.words.append(piece)
        if self.heading is not None:
            self.heading.append(piece)

    def handle_starttag(self, tag, attrs):
        self.flush()
        super().handle_starttag(tag, attrs)
        if tag in _VOID:
            return
        if tag == "title" and self.title is None:
            self.title, self.title_depth = [], len(self.open)
        elif tag in _HEADINGS and self.heading is None:
            self.heading, self.heading_depth = [], len(self.open)
            self.headings.setdefault(tag, [])
        self.open.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag):
        self.flush()
        if not self.count.get(tag):
            return
        while self.open:
            name = self.open.pop()
            self.count[name] -= 1
            if len(self.open) == self.title_depth:
                self.title_depth = -1
            if self.heading is not None and len(self.open) == self.heading_depth:
                self.headings[name].append(" ".join(self.heading))
                self.heading = None
            if name == tag:
                break

    def handle_data(self, data):
        self.node.append(data)

    def handle_charref(self, name):
        self.node.append(_numeric_reference(name))

    def handle_entityref(self, name):
        self.node.append(html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.node.append(data[6:])
            self.flush()

    def finish(self) -> None:
        self.flush()
        if self.heading is not None:
            self.headings[self.open[self.heading_depth]].append(" ".join(self.heading))



def _parse(text: str, with_text: bool):
    page = _Page() if with_text else _Attributes()
    try:
        page.feed(text)
        page.close()
    except AssertionError:
        # A malformed marked section ends the tokenizer; what was read stands.
        pass
    if with_text:
        page.finish()
    return page


def _field(page, name: str):
    if name == "title":
        return "".join(page.title or ())
    if name == "text":
        return " ".join(page.words)
    value = getattr(page, name)
    return list(value.items()) if isinstance(value, dict) else value


def fields_type(fields: Sequence[str]) -> str:
    return "struct<" + ",".join(f"{n}:{_TYPES[n][0]}" for n in fields) + ">"


def read_html(html: Column, fields: Sequence[str] = FIELDS) -> Column:
    """Struct of the named ``fields`` of each page; NULL in, NULL fields out."""
    fields = tuple(fields)
    with_text = bool(_TEXT_FIELDS.intersection(fields))
    types = [_TYPES[name][1] for name in fields]
    ddl = fields_type(fields)

    @F.arrow_udf(ddl)
    def parse_batch(pages: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in fields]
        for text in pages.to_pylist():
            page = None if text is None else _parse(text, with_text)
            for column, name in zip(columns, fields):
                column.append(None if page is None else _field(page, name))
        arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
        return pa.StructArray.from_arrays(arrays, names=list(fields))

    return parse_batch(html)


# Native links. Most markup is plain: it is a sequence of the tokens below and
# nothing else, and then the tokenizer above sees exactly the same tags. All loops
# are possessive, so matching is linear and takes no stack.
_WS = r"[ \t\r\n\f]"
_BARE_VALUE = r"[!#$%&()*+,\-./0-9:;?@A-Z\[\]\\^_a-z{|}~]++"
_VALUE = rf"(?:\x22[^\x22]*+\x22|\x27[^\x27]*+\x27|{_BARE_VALUE})"
_NAME = r"[A-Za-z0-9_:.@\-]++"
_ATTRIBUTES = rf"(?:{_WS}++{_NAME}(?:{_WS}*+={_WS}*+{_VALUE})?+)*+{_WS}*+"
_RAW_BODY = r"(?i:NAME)ATTRS>[^<]*+(?:<(?!/(?:\s|(?i:NAME)))[^<]*+)*+</(?i:NAME)>"
_RAW_TEXT = rf"(?:<{_RAW_BODY})"
_NOT_LINK = "|".join(
    [
        r"[^<]++",
        r"<!--[^\-]*+(?:-[^\-]++)*+-->",
        r"<!(?i:doctype)[^>]*+>",
        r"<\?[^>]*+>",
        rf"</[A-Za-z][A-Za-z0-9_:.\-]*+{_WS}*+>",
        r"<(?=[^A-Za-z/!?])",
        *(_RAW_TEXT.replace("NAME", n).replace("ATTRS", _ATTRIBUTES) for n in ("script", "style")),
        rf"<(?!(?i:a|script|style)[ \t\r\n\f/>])[A-Za-z][A-Za-z0-9_:.\-]*+{_ATTRIBUTES}/?+>",
    ]
)
_PLAIN = rf"^(?:{_NOT_LINK}|<[aA]{_ATTRIBUTES}/?+>)*+\z"
_LINKS = rf"(?:{_NOT_LINK})++|<[aA]({_ATTRIBUTES})/?+>"
_HREF = rf"(?i){_WS}++href(?:{_WS}*+={_WS}*+({_VALUE}))|{_WS}++{_NAME}(?:{_WS}*+={_WS}*+{_VALUE})?+"
_EMPTY_HREF = rf"(?i){_WS}href(?!{_WS}*+=)(?![A-Za-z0-9_:.@\-])"

# References that only the full tokenizer decodes: anything but &amp; that is a
# reference, with its semicolon or as one of the names that need none.
_LEGACY = "|".join(sorted(n for n in html5 if not n.endswith(";") and n != "amp"))
_REFERENCE = rf"&(?:#|{_LEGACY}|amp(?!;)|(?!amp;)[A-Za-z0-9]+;)"


def link_values(attribute_texts: str) -> str:
    """Decoded targets of the attribute texts of links; NULL where only the tokenizer decodes one."""

    def target(attributes: str) -> str:
        found = f"regexp_extract_all({attributes}, {raw(_HREF)}, 1)"
        value = f"element_at({keep(found, lambda v: f"{v} <> ''")}, -1)"
        return f"regexp_replace({value}, {raw(_QUOTES)}, '')"

    unclear = f"exists({attribute_texts}, t -> t RLIKE {raw(_EMPTY_HREF)} OR t RLIKE {raw(_REFERENCE)})"
    linked = keep(attribute_texts, lambda t: f"{t} RLIKE {raw(_HAS_HREF)}")
    values = each(linked, lambda t: f"replace({target(t)}, '&amp;', '&')")
    return f"if({unclear}, NULL, {values})"


def plain_hrefs(html: str) -> str:
    """Link targets of plain markup, decoded, in order; NULL for any other markup."""
    tags = f"regexp_extract_all({html}, {raw(_LINKS)}, 1)"
    return f"if({html} RLIKE {raw(_PLAIN)}, {let(keep(tags, lambda t: f"{t} <> ''"), link_values)}, NULL)"


_QUOTES = r"^[\x22\x27]|[\x22\x27]\z"
_HAS_HREF = rf"(?i){_WS}href{_WS}*+="


def with_hrefs(pages: DataFrame) -> DataFrame:
    """Pages with ``hrefs`` in place of ``html``: every ``<a href>`` value in order.

    Plain markup is read in the JVM; only the text of other pages goes through
    the tokenizer, as NULL is sent for the rest.
    """
    others = [c for c in pages.columns if c != "html"]
    native = pages.withColumn("native_hrefs", F.expr(plain_hrefs("html")))
    # ``rest`` is a column of its own, so that the markup is not carried past the
    # Python stage next to it.
    split = native.selectExpr(*others, "native_hrefs", "if(native_hrefs IS NULL, html, NULL) AS rest")
    return split.withColumn("page", read_html(F.col("rest"), ["hrefs"])).selectExpr(
        *others, "if(rest IS NULL, native_hrefs, page.hrefs) AS hrefs"
    )


def raw_hrefs(html: Column) -> Column:
    """Every quoted ``href=`` in the raw markup, in order, empty ones dropped."""
    found = F.regexp_extract_all(html, F.lit("(?i)href=['\"]([^\\n]*?)['\"]"), 1)
    return F.filter(found, lambda h: h != "")
