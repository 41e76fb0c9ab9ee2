"""Line and whitespace handling that follows Python's string rules."""

from __future__ import annotations

from sitelens.functions.sql import raw

# The characters Python's str.strip() removes and the line ends
# str.splitlines() honours, as Java character classes.
_BREAKS = r"\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029"
_BLANKS = r" \t\x1F\xA0\u1680\u2000-\u200A\u202F\u205F\u3000"
LINE_BREAK = f"[{_BREAKS}]"
LINE_END = rf"\r\n|{LINE_BREAK}"
BLANK = f"[{_BLANKS}]"
SPACE = f"[{_BLANKS}{_BREAKS}]"


def strip(text: str) -> str:
    """Trim all Unicode whitespace; Spark's ``trim`` removes spaces only."""
    edges = raw(rf"^{SPACE}+|{SPACE}+\z")
    return f"regexp_replace({text}, {edges}, '')"


def lines(text: str) -> str:
    """Split into lines at any line end."""
    return f"split({text}, {raw(LINE_END)})"


def is_text_type(content_type: str) -> str:
    """HTML and JSON bodies are text, everything else is bytes."""
    kind = f"lower(coalesce({content_type}, ''))"
    return f"(contains({kind}, 'html') OR contains({kind}, 'json'))"
