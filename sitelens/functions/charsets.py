"""Charsets of stored bodies: which one a body is in, and its text.

A byte-order mark decides first, then the header's parameter, then a meta declaration in
the first bytes of markup; an unknown label is passed over, and UTF-8 is what is left.
Single-byte charsets are decoded in the JVM: the bytes are read as code points and the
upper half is translated. Only bodies in multi-byte charsets other than UTF-8 go through
Python; NULL is sent for the rest. Bytes that mean nothing become replacement characters.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from sitelens.functions.sql import let, raw, text

# Executors get the decoder by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Charsets by the labels that the web knows them under, letters and digits
# only. As the HTML standard has it, Latin 1 and ASCII are read as windows-1252.
_LABELS = {
    "utf-8": "utf8 unicode11utf8 unicode20utf8 xunicode20utf8",
    "windows-1252": "windows1252 cp1252 xcp1252 iso88591 latin1 l1 ascii usascii ansix341968 cp819 ibm819",
    "windows-1250": "windows1250 cp1250 xcp1250",
    "windows-1251": "windows1251 cp1251 xcp1251",
    "windows-1253": "windows1253 cp1253 xcp1253",
    "windows-1254": "windows1254 cp1254 xcp1254 iso88599 latin5 l5",
    "windows-1255": "windows1255 cp1255 xcp1255",
    "windows-1256": "windows1256 cp1256 xcp1256",
    "windows-1257": "windows1257 cp1257 xcp1257",
    "windows-1258": "windows1258 cp1258 xcp1258",
    "windows-874": "windows874 dos874 iso885911 tis620",
    "iso-8859-2": "iso88592 latin2 l2",
    "iso-8859-3": "iso88593 latin3 l3",
    "iso-8859-4": "iso88594 latin4 l4",
    "iso-8859-5": "iso88595 cyrillic",
    "iso-8859-6": "iso88596 arabic",
    "iso-8859-7": "iso88597 greek greek8",
    "iso-8859-8": "iso88598 hebrew visual",
    "iso-8859-10": "iso885910 latin6 l6",
    "iso-8859-13": "iso885913",
    "iso-8859-14": "iso885914",
    "iso-8859-15": "iso885915 l9",
    "iso-8859-16": "iso885916",
    "koi8-r": "koi8r koi8 koi",
    "koi8-u": "koi8u koi8ru",
    "macintosh": "macintosh mac xmacroman",
    "ibm866": "ibm866 cp866 866",
    "utf-16le": "utf16le utf16 unicode ucs2 iso10646ucs2",
    "utf-16be": "utf16be unicodefffe",
    "shift_jis": "shiftjis sjis mskanji xsjis windows31j ms932",
    "euc-jp": "eucjp xeucjp",
    "iso-2022-jp": "iso2022jp",
    "gb18030": "gb18030 gbk xgbk gb2312 gb231280 chinese",
    "big5": "big5 big5hkscs cnbig5 xxbig5",
    "euc-kr": "euckr ksc5601 ksc56011987 korean windows949",
}
_MULTI = frozenset("utf-16le utf-16be shift_jis euc-jp iso-2022-jp gb18030 big5 euc-kr".split())
# What Python calls those that it knows under another name.
_CODECS = {"windows-874": "cp874", "macintosh": "mac-roman", "shift_jis": "cp932", "euc-kr": "cp949"}

_HEAD = 1024
_HEADER_CHARSET = r"(?i)(?:^|;)\s*charset\s*=\s*[\x22\x27]?\s*([^\s\x22\x27;]+)"
_META_CHARSET = r"(?i)<meta\s[^>]*?charset\s*=\s*[\x22\x27]?\s*([^\s\x22\x27/>;]+)"


def _map(entries: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in entries.items()) + ")"


def known(label: str) -> str:
    """The charset that a label names; NULL for other labels."""
    table = _map({alias: name for name, aliases in _LABELS.items() for alias in aliases.split()})
    return f"try_element_at({table}, regexp_replace(lower({label}), '[^a-z0-9]', ''))"


def from_mark(body: str) -> str:
    """The charset of a byte-order mark, or NULL."""
    start = f"hex(substr({body}, 1, 3))"
    return (
        f"CASE WHEN {start} = 'EFBBBF' THEN 'utf-8' WHEN startswith({start}, 'FEFF') THEN 'utf-16be'"
        f" WHEN startswith({start}, 'FFFE') THEN 'utf-16le' END"
    )


def from_header(content_type: str) -> str:
    return known(f"regexp_extract(coalesce({content_type}, ''), {raw(_HEADER_CHARSET)}, 1)")


def from_markup(body: str) -> str:
    """The charset that the first bytes declare. Readable as bytes, it can't be UTF-16: then it is UTF-8."""
    head = f"decode(substr({body}, 1, {_HEAD}), 'ISO-8859-1')"
    declared = known(f"regexp_extract({head}, {raw(_META_CHARSET)}, 1)")
    return let(declared, lambda c: f"if({c} IN ('utf-16le', 'utf-16be'), 'utf-8', {c})")


def resolve(body: str, content_type: str) -> str:
    """Charset of a text body; one that is not markup has no declaration."""
    markup = f"if(contains(lower(coalesce({content_type}, '')), 'html'), {from_markup(body)}, NULL)"
    return f"coalesce({from_mark(body)}, {from_header(content_type)}, {markup}, 'utf-8')"


def _upper_half(charset: str) -> str:
    codec = _CODECS.get(charset, charset.replace("windows-", "cp") if charset.startswith("windows") else charset)
    return bytes(range(128, 256)).decode(codec, "replace")


def _in_jvm(body: str, charset: str) -> str:
    """Text of a body in UTF-8 or a single-byte charset."""
    single = {c: _upper_half(c) for c in _LABELS if c not in _MULTI and c != "utf-8"}
    upper = text("".join(map(chr, range(128, 256))))
    points = f"decode({body}, 'ISO-8859-1')"
    unmarked = f"if(startswith(hex(substr({body}, 1, 3)), 'EFBBBF'), substr({body}, 4), {body})"
    return (
        f"if({charset} = 'utf-8', make_valid_utf8(cast({unmarked} AS string)),"
        f" translate({points}, {upper}, element_at({_map(single)}, {charset})))"
    )


def _decode(body: bytes, charset: str) -> str:
    mark = {"utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff"}.get(charset)
    if mark and body.startswith(mark):
        body = body[2:]
    # A lone half of a surrogate pair can't be stored.
    decoded = body.decode(_CODECS.get(charset, charset), "replace")
    return decoded.encode("utf-8", "replace").decode("utf-8")


def _in_python(body: Column, charset: Column) -> Column:
    @F.arrow_udf("string")
    def decode_batch(bodies: pa.Array, charsets: pa.Array) -> pa.Array:
        pairs = zip(bodies.to_pylist(), charsets.to_pylist())
        return pa.array([None if b is None else _decode(b, c) for b, c in pairs], pa.string())

    return decode_batch(body, charset)


def with_text(responses: DataFrame, body: str = "body", charset: str = "charset") -> DataFrame:
    """Adds ``text``: the body decoded from the charset named in the row; NULL without a charset."""
    multi = ", ".join(text(c) for c in sorted(_MULTI))
    others = responses.columns
    split = responses.selectExpr(
        "*",
        f"if({charset} IN ({multi}), NULL, {_in_jvm(body, charset)}) AS plain_text",
        f"if({charset} IN ({multi}), {body}, NULL) AS rest",
    )
    return split.withColumn("decoded", _in_python(F.col("rest"), F.col(charset))).selectExpr(*others, "coalesce(plain_text, decoded) AS text")
