"""Sitemap scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.functions.sitemaps import locations


def sitemap_urls(sitemaps: DataFrame, *keep_columns: str) -> DataFrame:
    """One row per location of each sitemap, in order."""
    return sitemaps.selectExpr(*keep_columns, f"posexplode({locations('xml')}) AS (pos, url)")
