"""Snapshot scans: stored responses become pages with text or bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.functions import charsets
from sitelens.functions.text import is_text_type


def page_scan(responses: DataFrame, *keep_columns: str) -> DataFrame:
    """Exactly one of ``text`` and ``body`` is set, by content type; ``charset`` is that of the text.

    A text body is decoded from the charset that it is marked or declared to be in; bytes
    without a meaning there become replacement characters.
    """
    is_text = is_text_type("content_type")
    resolved = responses.selectExpr(
        *keep_columns,
        "url",
        "body",
        f"if({is_text}, {charsets.resolve('body', 'content_type')}, NULL) AS charset",
    )
    return charsets.with_text(resolved).selectExpr(
        *keep_columns, "url", "charset", "text", "if(charset IS NULL, body, NULL) AS body"
    )
