"""Sitemap locations as a native expression that tolerates malformed XML."""

from __future__ import annotations

from sitelens.functions.sql import each, keep, let, raw, text
from sitelens.functions.text import strip

# A comment is consumed whole, so a location inside it is not found. The text of
# a location ends at its first child, as in a tree that was recovered.
_LOCATION = (
    r"(?s)<!--.*?(?:-->|\z)"
    r"|<(?:[\w.\-]+:)?loc(?:\s[^>]*)?(?<!/)>([^<]*(?:<!\[CDATA\[.*?\]\]>[^<]*)*)"
)
_CDATA = r"(?s)<!\[CDATA\[(.*?)\]\]>"

# The entities XML predefines.
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _code_point(number: str) -> str:
    return f"decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32')"


def decode_entities(value: str) -> str:
    """Replace predefined and numeric references, each once, in one pass."""

    def piece(p: str) -> str:
        name = f"regexp_extract({p}, {raw('^(#x[0-9a-fA-F]+|#[0-9]+|[a-z]+);')}, 1)"

        def replaced(n: str) -> str:
            named = " ".join(f"WHEN {n} = '{k}' THEN {text(v)}" for k, v in _ENTITIES.items())
            hexed = _code_point(f"cast(conv(substr({n}, 3), 16, 10) AS bigint)")
            decimal = _code_point(f"cast(substr({n}, 2) AS bigint)")
            char = (
                f"CASE {named} WHEN startswith({n}, '#x') THEN {hexed}"
                f" WHEN startswith({n}, '#') THEN {decimal} END"
            )
            return f"coalesce({char} || substr({p}, length({n}) + 2), '&' || {p})"

        return let(name, replaced)

    def joined(parts: str) -> str:
        rest = each(f"slice({parts}, 2, size({parts}))", piece)
        return f"{parts}[0] || array_join({rest}, '')"

    return f"if(contains({value}, '&'), {let(f"split({value}, '&')", joined)}, {value})"


def locations(xml: str) -> str:
    """All locations in order, stripped, duplicates kept; those without any text dropped."""
    found = f"regexp_extract_all({xml}, {raw(_LOCATION)}, 1)"
    unwrapped = each(found, lambda l: f"regexp_replace({l}, {raw(_CDATA)}, '$1')")
    return each(keep(unwrapped, lambda l: f"{l} <> ''"), lambda l: strip(decode_entities(l)))
