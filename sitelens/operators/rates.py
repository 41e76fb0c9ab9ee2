"""Requests per period: when a site was asked more often than its limit allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Length of a time bucket in periods: only the last of them reaches into the next bucket.
_BUCKET_PERIODS = 64


def bursts(requests: DataFrame, limit: int, period: str) -> DataFrame:
    """``site, ts, n``: moments of requests at which more than ``limit`` lie in the last ``period``.

    ``requests``: ``site, ts``. The ``period`` ends at the moment, which belongs to it, and
    its own start does not. A sweep: each request adds one at its time and takes it off a
    period later, and a running sum counts. Sites are cut into buckets of time, so that a
    site with most of the requests is many groups; a request that is still counted at the
    end of its bucket is added once more at the start of the next. Rows without a time or
    site are no requests.
    """
    length = f"(interval {period})"
    micros = f"(unix_micros(timestamp'1970-01-01 00:00:00Z' + {length}))"
    timed = requests.filter("site IS NOT NULL AND ts IS NOT NULL").selectExpr(
        "site", "unix_micros(cast(ts AS timestamp)) AS at", f"{micros} AS period"
    )
    width = f"({_BUCKET_PERIODS} * period)"
    # Equal moments are one step of the sweep; a site's requests are first added up by it.
    steps = timed.groupBy("site", "at", "period").agg(F.count(F.lit(1)).alias("k"))
    swept = steps.selectExpr(
        "site", "k", "at", "at + period AS off", f"floor(at / {width}) AS mine", f"floor((at + period) / {width}) AS last",
        f"floor((at + period) / {width}) * {width} AS edge",
    ).selectExpr(
        "site",
        """inline(if(mine = last,
            array(struct(mine AS bucket, at, k AS change, true AS asked), struct(mine AS bucket, off AS at, -k AS change, false AS asked)),
            array(struct(mine AS bucket, at, k AS change, true AS asked),
                  struct(last AS bucket, edge - 1 AS at, k AS change, false AS asked),
                  struct(last AS bucket, off AS at, -k AS change, false AS asked))))""",
    )
    running = F.sum("change").over(
        Window.partitionBy("site", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = swept.withColumn("n", running).filter(f"asked AND n > {limit}")
    return counted.selectExpr("site", "cast(timestamp_micros(at) AS timestamp_ntz) AS ts", "n")
