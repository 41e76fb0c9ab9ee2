"""Report sink and source: JSON lines, one per entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.schemas import REPORT_ROW

_ENTRIES = ("page", "document", "hidden", "locale")


def as_json(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """``site, section, seq, json``; NULL fields are written, other alphabets kept as they are."""
    options = f"map('ignoreNullFields', 'false', 'pretty', '{str(pretty).lower()}')"
    texts = ", ".join(f"to_json({e}, {options})" for e in _ENTRIES)
    return rows.selectExpr("site", "section", "seq", f"coalesce({texts}, '{{}}') AS json")


def write_reports(rows: DataFrame, path: str) -> None:
    """Write report rows as JSON lines, with their site, section and number."""
    rows.write.json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Read report rows back with the fixed schema."""
    return spark.read.schema(REPORT_ROW).json(path)
