"""Bursts of requests, and the languages that requests accept."""

import datetime as dt
import random

import pytest

from sitelens.operators import locales, rates

START = dt.datetime(2024, 1, 1)


def brute_force(rows, limit, seconds):
    out = set()
    for site, ts in rows:
        if site is None or ts is None:
            continue
        n = sum(s == site and t is not None and ts - dt.timedelta(seconds=seconds) < t <= ts for s, t in rows)
        if n > limit:
            out.add((site, ts, n))
    return sorted(out)


@pytest.mark.parametrize("limit, seconds, span", [(2, 1, 30), (5, 3, 400), (1, 10, 5000), (0, 1, 100)])
def test_bursts_equal_brute_force(spark, limit, seconds, span):
    rnd = random.Random(span)
    rows = [
        (rnd.choice("aaab"), START + dt.timedelta(milliseconds=rnd.choice((1, 250, 1000)) * rnd.randrange(span)))
        for _ in range(300)
    ]
    rows += rows[:20] + [(None, START), ("a", None)]
    df = spark.createDataFrame(rows, "site STRING, ts TIMESTAMP_NTZ")
    got = sorted(map(tuple, rates.bursts(df, limit, f"{seconds} seconds").collect()))
    assert got == brute_force(rows, limit, seconds)


def test_bursts_reach_across_buckets(spark):
    """A request a second, three of them at every edge of the buckets of 64 seconds."""
    rows = [("hot", START + dt.timedelta(seconds=64 * k + d)) for k in range(40) for d in (-0.5, 0, 0.25)]
    df = spark.createDataFrame(rows, "site STRING, ts TIMESTAMP_NTZ")
    got = sorted(map(tuple, rates.bursts(df, 2, "1 second").collect()))
    assert got == brute_force(rows, 2, 1) and len(got) == 40


def test_no_task_sorts_a_whole_site(spark):
    df = spark.createDataFrame([("a", START)], "site STRING, ts TIMESTAMP_NTZ")
    text = rates.bursts(df, 1, "1 second")._jdf.queryExecution().executedPlan().toString()
    window = next(line for line in text.splitlines() if "Window [" in line)
    assert "bucket" in window


RULES = {
    "cn": {"accept_languages": ["zh", "zh-CN"]},
    "tw": {"accept_languages": ["zh-Hant"]},
    "de": {"accept_languages": ["de"]},
    "at": {"accept_languages": ["de", "de-AT"]},
    "x": {"accept_languages": []},
}


@pytest.mark.parametrize(
    "header, lang",
    [
        ("de", "de"), ("de-AT", "at"), ("de-at-1996", "at"), ("de-CH", "de"), ("ZH-hant-x-y", "tw"), ("zh-x-hant", "cn"),
        ("zh;q=0.5,de;q=0.6", "de"), ("zh;q=0.5, de;q=0.5", "cn"), ("de;q=0,zh;q=0.001", "cn"), ("de;q=0", None),
        ("*", None), ("en", None), ("", None), (None, None), ("de;q=2, zh;q=0.1", "cn"), (" ,, de ; q = 1.000 ", "de"),
        ("fr, de-CH;q=0.2, zh;q=0.3", "cn"), ("de_AT", None),
    ],
)
def test_request_locales(spark, header, lang):
    df = spark.createDataFrame([(1, header)], "i INT, h STRING")
    assert [tuple(r) for r in locales.request_locales(df, RULES, "h", "i").collect()] == [(1, lang)]


def test_no_rules_name_no_locale(spark):
    df = spark.createDataFrame([(1, "de")], "i INT, h STRING")
    assert locales.request_locales(df, {}, "h", "i").head().lang is None
