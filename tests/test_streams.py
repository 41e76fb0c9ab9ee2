"""Streams in several batches give what one batch job gives."""

import datetime as dt
import random

from sitelens.functions import urls
from sitelens.operators.links import internal_links
from sitelens.operators.outcomes import fetch_outcomes
from sitelens.streaming import jobs


def in_files(df, path, n):
    df.repartition(n).write.parquet(str(path))
    return jobs.stream_of(df, str(path), files=1)


def test_new_links(spark, tmp_path):
    rows = [
        (i, f"s{i % 2}", f"http://s{i % 2}/p{i}", "".join(f"<a href='/t{j % 7}/'>" for j in range(i)))
        for i in range(12)
    ]
    df = spark.createDataFrame(rows, "page_id INT, site STRING, url STRING, html STRING")
    got = jobs.run_new_links(in_files(df, tmp_path / "in", 4))
    want = internal_links(df, "site").selectExpr("site", f"{urls.crawl_form_of('link')} AS url").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_outcomes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"u{i % 20}", i // 20 + 1, rng.choice([200, 404, 500, 429, None, 503])) for i in range(100)]
    df = spark.createDataFrame(rows, "url STRING, attempt INT, status INT")
    got = jobs.run_fetch_outcomes(in_files(df, tmp_path / "in", 5))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, fetch_outcomes(df).collect()))


def test_rate_audit_keeps_closed_windows_over_the_limit(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    times = [("a", 1), ("a", 2), ("a", 3), ("b", 5), ("a", 25), ("a", 26), ("a", 27), ("b", 50)]
    df = spark.createDataFrame(
        [(s, day + dt.timedelta(hours=h)) for s, h in times], "site STRING, ts TIMESTAMP"
    )
    got = jobs.run_rate_audit(in_files(df, tmp_path / "in", 1), 2, "1 day", "3 hours")
    # The second day ends at hour 48, beyond the watermark of hour 47.
    assert [tuple(r) for r in got.collect()] == [("a", day, 3)]


PAGE = "page_id INT, site STRING, url STRING, html STRING, ts TIMESTAMP"


def state_rows(query):
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=round(60 * hours))


def slices(spark, path, schema, *batches):
    """A folder with a file per batch, written one after the other."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return jobs.stream_of(spark.read.parquet(str(path)), str(path), files=1)


def test_links_are_new_again_after_a_gap_and_leave_the_state(spark, tmp_path):
    def seen(*rows):
        return [(i, "s", "http://s/p", f"<a href='/{name}'>", at(h)) for i, (name, h) in enumerate(rows)]

    stream = slices(
        spark, tmp_path / "in", PAGE,
        seen(("x", 0), ("y", 0.5), ("x", 1)),
        seen(("x", 2.5), *((f"t{i}", 5) for i in range(20)), ("z", 4.5)),
        # Late, but within the delay: it joins the mentions of z.
        seen(("z", 4), ("x", 9), ("x", 12)),
        seen(("w", 40), ("x", 0.1)),
        seen(("w", 41)),
    )
    links = jobs.recent_new_links(stream, "ts", "2 hours", "1 hour")
    query = links.writeStream.format("memory").queryName("recent").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = sorted((r.url[9:], r.first_seen, r.n) for r in spark.table("recent").collect() if "/t" not in r.url)
    # x at 0.1 comes when the watermark is at 39 and is dropped; w's gap has not passed.
    assert got == [("x", at(0), 3), ("x", at(9), 1), ("x", at(12), 1), ("y", at(0.5), 1), ("z", at(4), 2)]
    totals = state_rows(query)
    assert max(totals) >= 20 and totals[-1] == 1


def due_by_hand(rows, delay_h, unit_h, retry_times=3):
    """Ordered by time, per URL: due unless another attempt was made by then."""
    end = max(ts for _, _, ts, _ in rows) - dt.timedelta(hours=delay_h)
    out = []
    for url in {r[0] for r in rows}:
        mine = sorted((ts, k, status) for u, k, ts, status in rows if u == url)
        for (ts, k, status), later in zip(mine, [*mine[1:], None]):
            due = ts + dt.timedelta(hours=unit_h * min(2**k, 60))
            retried = status is not None and (status in (0, 429) or 500 <= status < 600) and k <= retry_times
            if retried and due <= end and (later is None or later[0] > due):
                out.append((url, k, due))
    return sorted(out)


def test_retries_come_due(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for u in range(40):
        ts = rng.randrange(100 * 60) / 60
        for k in range(1, rng.randrange(2, 6)):
            rows.append((f"u{u}", k, at(ts), rng.choice([500, 503, 429, 0, 200, 404, None])))
            ts += rng.choice((0.5, 1.9, 3, 7, 30))
    rows += [("last", 1, at(300), 500), rows[3], rows[9]]
    schema = "url STRING, attempt INT, ts TIMESTAMP, status INT"
    rows.sort(key=lambda r: r[2])
    # Each file is shuffled and reaches two hours into the next one.
    cut = [[r for r in rows if lo <= (r[2] - at(0)).total_seconds() / 3600 + rng.uniform(0, 2) < lo + 40] for lo in range(0, 320, 40)]
    missing = [r for r in rows if not any(r in c for c in cut)]
    batches = [rng.sample(c, len(c)) for c in cut if c]
    batches[0] += missing
    stream = slices(spark, tmp_path / "in", schema, *batches)
    delay = 120
    due = jobs.due_retries(stream, f"{delay} hours", unit_s=3600)
    flat = [r for b in batches for r in b]
    query = due.writeStream.format("memory").queryName("due").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = sorted({(r.url, r.attempt, r.due) for r in spark.table("due").collect()})
    assert got == due_by_hand(sorted(set(flat), key=str), delay, 1) and len(got) > 20
    # What the watermark and the longest wait have passed is gone.
    left = [r for r in flat if r[2] > at(300 - delay - 60)]
    assert state_rows(query)[-1] <= 2 * len(left) < len(flat)


def test_empty_streams_give_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id INT, site STRING, url STRING, html STRING")
    assert jobs.run_new_links(in_files(pages, tmp_path / "pages", 1)).count() == 0
    attempts = spark.createDataFrame([], "url STRING, attempt INT, status INT")
    assert jobs.run_fetch_outcomes(in_files(attempts, tmp_path / "attempts", 1)).count() == 0
    requests = spark.createDataFrame([], "site STRING, ts TIMESTAMP")
    assert jobs.run_rate_audit(in_files(requests, tmp_path / "requests", 1), 2, "1 day", "3 hours").count() == 0
