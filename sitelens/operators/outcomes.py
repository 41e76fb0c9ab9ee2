"""Fetch outcomes from an attempt log.

Order-free aggregates only, so the same code runs over a stored log and over a
stream, and a URL with very many attempts is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Statuses that are tried again (0 logs a connection error), the
# ceiling of one back-off in seconds.
RETRY_STATUS = "(status = 0 OR status = 429 OR status BETWEEN 500 AND 599)"
MAX_BACKOFF_S = 60

_FINAL = f"(status IS NULL OR NOT {RETRY_STATUS})"


def _backoff(retries: str) -> str:
    """Sum of ``min(2**k, 60)`` over the retries ``k = 1..n``: five terms grow."""
    return (
        f"(shiftleft(1, least({retries}, 5) + 1) - 2"
        f" + {MAX_BACKOFF_S} * greatest({retries} - 5, 0))"
    )


def fetch_outcomes(attempts: DataFrame, retry_times: int = 3) -> DataFrame:
    """One outcome per URL: page, not_found, timeout, exhausted or pending.

    The first attempt that is not retried decides; NULL status is a timeout. A row
    that was logged twice counts once.
    Attempts beyond ``retry_times + 1`` are never made.
    """
    tries = retry_times + 1
    resolved = (
        attempts.filter(F.col("attempt") <= tries)
        .groupBy("url")
        .agg(
            F.expr(f"min(attempt) FILTER (WHERE {_FINAL})").alias("decided"),
            F.expr(f"min_by(coalesce(status, -1), attempt) FILTER (WHERE {_FINAL})").alias("code"),
            F.expr("cast(max(attempt) AS int)").alias("made"),
        )
    )
    retries = f"(coalesce(decided - 1, least(made, {retry_times})))"
    return resolved.selectExpr(
        "url",
        f"""CASE WHEN decided IS NULL AND made >= {tries} THEN 'exhausted'
                 WHEN decided IS NULL THEN 'pending'
                 WHEN code = -1 THEN 'timeout'
                 WHEN code = 404 THEN 'not_found'
                 ELSE 'page' END AS outcome""",
        "coalesce(decided, made) AS attempts",
        "nullif(code, -1) AS status",
        f"cast({_backoff(retries)} AS int) AS backoff_s",
    )
