"""JSON text as native expressions, laid out with an indent of two spaces.

``to_json`` has a layout of its own; these give the one that report files have: a key or
element a line, ``": "`` behind keys, empty arrays and objects on one line, other
alphabets as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from sitelens.functions.sql import each


def quoted(value: str) -> str:
    """A string expression as a JSON string, NULL as ``null``."""
    literal = f"to_json(array({value}), map('ignoreNullFields', 'false'))"
    return f"if({value} IS NULL, 'null', substr({literal}, 2, length({literal}) - 2))"


def number(value: str) -> str:
    return f"coalesce(cast({value} AS string), 'null')"


def _laid_out(items: str, brackets: str, indent: int) -> str:
    """An array of rendered items between brackets, each on a line."""
    inside, outside = "\\n" + " " * (indent + 2), "\\n" + " " * indent
    body = f"concat('{brackets[0]}{inside}', array_join({items}, ',{inside}'), '{outside}{brackets[1]}')"
    return f"if(size({items}) = 0, '{brackets}', {body})"


def array_text(array: str, indent: int, item: Callable[[str], str] = quoted) -> str:
    """An array; ``indent`` is that of the line that it starts on. NULL is an empty one."""
    return _laid_out(each(f"coalesce({array}, array())", item), "[]", indent)


def map_text(entries: str, indent: int, value: Callable[[str], str] = quoted) -> str:
    """A map with string keys, in its own order; NULL is an empty one."""
    pairs = each(
        f"map_entries(coalesce({entries}, map()))", lambda e: f"concat({quoted(f'{e}.key')}, ': ', {value(f'{e}.value')})"
    )
    return _laid_out(pairs, "{}", indent)


def object_text(fields: dict[str, str], indent: int) -> str:
    """An object of rendered values under fixed keys."""
    inside = "\\n" + " " * (indent + 2)
    lines = [f"'{inside}\"{key}\": ', {text}" for key, text in fields.items()]
    return "concat('{', " + ", ',', ".join(lines) + ", '\\n" + " " * indent + "}')"
