"""Small helpers for composing Spark SQL expressions as text.

Expressions here are SQL text handed to ``expr``/``selectExpr``: Catalyst gets
the same tree as from Column calls, and nested lambdas stay readable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

_serial = count()


def raw(pattern: str) -> str:
    """A raw string literal, for regular expressions; no single quotes inside."""
    assert "'" not in pattern
    return f"r'{pattern}'"


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Iterable[str]) -> str:
    return ", ".join(text(v) for v in values)


def _name() -> str:
    return f"v{next(_serial)}"


def each(array: str, body: Callable[[str], str]) -> str:
    """Transform every element; ``body`` gets the element's name."""
    item = _name()
    return f"transform({array}, {item} -> {body(item)})"


def each_indexed(array: str, body: Callable[[str, str], str]) -> str:
    item, index = _name(), _name()
    return f"transform({array}, ({item}, {index}) -> {body(item, index)})"


def keep(array: str, test: Callable[[str], str]) -> str:
    item = _name()
    return f"filter({array}, {item} -> {test(item)})"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it by name in ``body``."""
    return f"element_at({each(f'array({value})', body)}, 1)"


def struct(**fields: str) -> str:
    inner = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    return f"named_struct({inner})"
