"""Incremental link discovery, retry state and rate audits.

All three run with the available-now trigger: they take what has arrived since
the last run, and their state lives in the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sitelens.operators.links import link_targets
from sitelens.operators.outcomes import fetch_outcomes
from sitelens.session import materialize, scratch_path
from sitelens.streaming.retries import due_retries


def _start_empty(schema: StructType, path: str) -> None:
    """An empty table at ``path``, so that a stream without any rows can be read back."""
    SparkSession.active().createDataFrame([], schema).write.parquet(path)


def _run(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def new_links(pages: DataFrame) -> DataFrame:
    """Canonical internal links of a stream of pages, each once per site.

    The seen set is exact and grows with the links, as the visited set of a
    crawl does. It is hashed over site and URL, so a hot site is spread.
    """
    found = link_targets(pages, "site").select("site", "url")
    return found.dropDuplicates(["site", "url"])


def recent_new_links(pages: DataFrame, event_time: str, gap: str, delay: str) -> DataFrame:
    """As :func:`new_links` with bounded state: a link is new again if nobody named it for ``gap``.

    ``site, url, first_seen, n``: a row for each time a link was new, with the number of
    pages that named it until it was forgotten. Rows come when the watermark, ``delay``
    behind the latest page, passes the end of the gap; with that the link leaves the
    state. Which batch a page comes in makes no difference; later ones than ``delay`` are
    dropped.
    """
    found = link_targets(pages, "site", event_time).select("site", event_time, "url")
    return (
        found.withWatermark(event_time, delay)
        .groupBy("site", "url", F.session_window(event_time, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("site", "url", "cast(w.start AS timestamp_ntz) AS first_seen", "n")
    )


def _drained(stream: DataFrame, label: str) -> DataFrame:
    """Drain an appending stream into a written table."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    _start_empty(stream.schema, out)
    _run(
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
    )
    return spark.read.schema(stream.schema).parquet(out)


def run_recent_links(pages: DataFrame, event_time: str, gap: str, delay: str) -> DataFrame:
    """Drain a stream of pages into a written table of links and when they were new."""
    return _drained(recent_new_links(pages, event_time, gap, delay), "recent-links")


def run_due_retries(attempts: DataFrame, delay: str, retry_times: int = 3, unit_s: int = 1) -> DataFrame:
    """Drain a stream of attempts into a table of the retries that came due, each once."""
    return _drained(due_retries(attempts, delay, retry_times, unit_s), "due-retries").distinct()


def run_new_links(pages: DataFrame) -> DataFrame:
    """Drain a stream of pages into a written table of new links."""
    spark = pages.sparkSession
    links = new_links(pages)
    out, state = scratch_path(spark, "new-links"), scratch_path(spark, "new-links-state")
    _start_empty(links.schema, out)
    _run(links.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    return spark.read.schema(links.schema).parquet(out)


def run_fetch_outcomes(attempts: DataFrame, retry_times: int = 3) -> DataFrame:
    """Drain a stream of attempts; the latest outcome of each URL.

    Outcomes change as attempts arrive, so each batch writes its changed URLs
    under its own number; writing a batch again replaces it.
    """
    spark = attempts.sparkSession
    outcomes = fetch_outcomes(attempts, retry_times)
    out, state = scratch_path(spark, "outcomes"), scratch_path(spark, "outcomes-state")

    _start_empty(outcomes.schema, f"{out}/batch=-1")

    def write_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(
        outcomes.writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .foreachBatch(write_batch)
    )
    columns = outcomes.columns
    changes = spark.read.schema(_with_batch(outcomes)).parquet(out)
    latest = changes.groupBy("url").agg(
        F.max_by(F.struct(*columns), "batch").alias("latest")
    )
    return latest.select("latest.*")


def _with_batch(df: DataFrame) -> str:
    return f"{df.schema.toDDL()}, batch BIGINT"


def over_limit(
    requests: DataFrame, limit: int, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Closed windows in which a site got more than ``limit`` requests.

    ``requests``: ``site, ts``; rows later than ``delay`` are dropped.
    """
    return (
        requests.withWatermark("ts", delay)
        .groupBy("site", F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > limit)
        .selectExpr("site", "cast(w.start AS timestamp_ntz) AS window_start", "n")
    )


def run_rate_audit(requests: DataFrame, limit: int, window: str, delay: str) -> DataFrame:
    """Drain a stream of requests into a written table of windows over the limit."""
    spark = requests.sparkSession
    audited = over_limit(requests, limit, window, delay)
    out, state = scratch_path(spark, "rate-audit"), scratch_path(spark, "rate-audit-state")
    _start_empty(audited.schema, out)
    _run(
        audited.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
    )
    return spark.read.schema(audited.schema).parquet(out)


def write_by_time(df: DataFrame, label: str, time: str, slices: int, files: int = 2) -> DataFrame:
    """Write ``df`` slice after slice of its times and stream it, about a slice per batch.

    Files are streamed in the order in which they were written, so that a row is at most
    a slice late.
    """
    spark = df.sparkSession
    stored = materialize(df, label)
    folder = scratch_path(spark, f"{label}-by-time")
    _start_empty(stored.schema, folder)
    low, high = stored.selectExpr(f"unix_micros(min({time}))", f"unix_micros(max({time}))").head()
    step = ((high or 0) - (low or 0)) // slices + 1
    for i in range(slices):
        inside = f"unix_micros({time}) - {low or 0} BETWEEN {i * step} AND {(i + 1) * step - 1}"
        stored.filter(inside).repartition(files).write.mode("append").parquet(folder)
    return stream_of(stored, folder, files)


def stream_of(stored: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Stream of the table written to ``folder``; ``files`` per batch, all at once by default."""
    reader = stored.sparkSession.readStream.schema(stored.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)
