"""Fixed schemas of inputs and reports."""

from __future__ import annotations

PAGE_INFO = (
    "STRUCT<url: STRING, links: ARRAY<STRING>, meta: MAP<STRING, STRING>, "
    "headings: MAP<STRING, ARRAY<STRING>>, headers: MAP<STRING, STRING>>"
)
DOCUMENT_INFO = "STRUCT<name: STRING, url: STRING, size: BIGINT, mime: STRING>"
HIDDEN_INFO = "STRUCT<url: STRING, status: INT, type: STRING, size: BIGINT>"
LOCALE_INFO = "STRUCT<lang: STRING, url: STRING>"
REPORT_ROW = (
    f"site STRING, section STRING, seq BIGINT, page {PAGE_INFO}, document {DOCUMENT_INFO}, "
    f"hidden {HIDDEN_INFO}, locale {LOCALE_INFO}"
)
