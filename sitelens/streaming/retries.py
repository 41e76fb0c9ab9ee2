"""Retry schedule of a stream of fetch attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelens.operators.outcomes import MAX_BACKOFF_S, RETRY_STATUS


def due_retries(attempts: DataFrame, delay: str, retry_times: int = 3, unit_s: int = 1) -> DataFrame:
    """``url, attempt, due`` of every retry whose time came before another attempt was made.

    ``attempts``: ``url, attempt, ts, status``. After attempt ``k`` with a retried status
    the next try is due ``min(2**k, 60)`` units later, if it is one of ``retry_times``. An
    attempt made by then, whatever its status, takes the place of the waiting one. An
    attempt that was logged twice is waited for twice.

    The wait is an outer join of the stream with itself: a failed attempt stays in the
    state until the watermark, ``delay`` behind the latest times, passes its due time, and
    is given out then if no later attempt has met it. Attempts stay as long as a due time
    may still lie behind them. So the order in which rows arrive within the delay makes
    no difference, and the state holds the delay and the longest wait, not the log.
    """
    retried = f"{RETRY_STATUS} AND attempt <= {retry_times}"
    wait = f"{unit_s} * least(shiftleft(1, least(attempt, 6)), {MAX_BACKOFF_S})"
    failed = (
        attempts.filter(retried)
        .selectExpr("url", "cast(attempt AS int) AS attempt", "cast(ts AS timestamp) AS made")
        .selectExpr("*", f"made + make_dt_interval(0, 0, 0, {wait}) AS due")
        .withWatermark("due", delay)
    )
    made = attempts.selectExpr(
        "url AS next_url", "attempt AS next_attempt", "cast(ts AS timestamp) AS next_ts"
    ).withWatermark("next_ts", delay)
    by_then = F.expr(
        f"""url = next_url AND next_ts <= due AND due <= next_ts + interval {unit_s * MAX_BACKOFF_S} seconds
            AND (next_ts > made OR (next_ts = made AND next_attempt > attempt))"""
    )
    return failed.join(made, by_then, "left_outer").filter("next_url IS NULL").select("url", "attempt", "due")
