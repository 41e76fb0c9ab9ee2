"""Dedup of link tables; every step aggregates on the map side first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


# A position inside a page is below 2**28: a text is at most 2 GB and a link
# takes at least eight characters.
_PAGE_STEP = 1 << 28


def stable(links: DataFrame, keys: list[str], page: str, pos: str) -> DataFrame:
    """Distinct ``keys`` with the ``page`` and ``pos`` of their first occurrence.

    Both go into one exact decimal: unlike a struct, its minimum is kept by hash
    aggregation, so no row is sorted before the shuffle.
    """
    place = F.expr(f"cast({page} AS decimal(20,0)) * {_PAGE_STEP} + {pos}")
    return (
        links.groupBy(*keys)
        .agg(F.min(place).alias("place"))
        .selectExpr(
            *keys,
            f"cast(floor(place / {_PAGE_STEP}) AS bigint) AS {page}",
            f"cast(pmod(place, {_PAGE_STEP}) AS int) AS {pos}",
        )
    )


def unordered(links: DataFrame, keys: list[str]) -> DataFrame:
    return links.select(*keys).distinct()


def duplicate_counts(links: DataFrame, group: str, value: str) -> DataFrame:
    """Per group its rows and how many a dedup removes.

    Counting per value first spreads a hot group over all its values.
    """
    return (
        links.groupBy(group, value)
        .count()
        .groupBy(group)
        .agg(
            F.sum("count").alias("total"),
            (F.sum("count") - F.count(F.lit(1))).alias("removed"),
        )
    )
