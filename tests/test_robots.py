"""Both robots dialects and the verdict."""

import pytest
from pyspark.sql import functions as F

from sitelens.functions import robots
from sitelens.operators.robots import directives, rule_lists, site_rules

AGENT = "TestAgent/1.0"

VERDICTS = [
    # text, path, allowed
    ("", "/x", True),
    ("Disallow: /x", "/x", True),
    ("User-agent: *\nDisallow:", "/x", True),
    ("User-agent: *\nDisallow: /x", "/xy", False),
    ("User-agent: *\nDisallow: /x\nAllow: /xy", "/xyz", True),
    ("User-agent: *\nAllow: /xy\nDisallow: /x", "/xyz", False),
    ("User-agent: Other\nDisallow: /\nUser-agent: *\nDisallow: /x", "/y", True),
    ("User-agent: *\nDisallow: /x\nUser-agent: testagent\nAllow: /", "/x", False),
    ("User-agent: TESTAGENT\nDisallow: /x", "/x", False),
    ("User-agent: TestAgent/1.0.1\nDisallow: /x", "/x", True),
    ("User-agent:\nDisallow: /x", "/x", False),
    ("User-agent\nDisallow: /x", "/x", False),
    ("User-agent: a\nUser-agent: testagent\nDisallow: /x", "/x", False),
    ("User-agent: testagent\nUser-agent: b\nDisallow: /x", "/x", True),
    ("user-AGENT : * # all\n disallow : /x # no", "/x", False),
    ("#User-agent: *\nDisallow: /x", "/x", True),
    ("User-agent: *\r\nDisallow: /x\r\nAllow: /x/ok", "/x/ok", True),
    ("User-agent: *\rDisallow: /x", "/x", False),
    ("User-agent: *\nAllow:\nDisallow: /x", "/x", False),
    ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf", True),
    ("User-agent: *\nDisallow: /a:b", "/a:b", False),
    ("User-agent: *\nDisallow: /", "", True),
    ("Sitemap: s\nUser-agent: *\n\n\nCrawl-delay: 1\nDisallow: /x", "/x", False),
]


def test_verdicts(spark):
    df = spark.createDataFrame(VERDICTS, "text STRING, path STRING, want BOOLEAN")
    rules = robots.rules_for(robots.groups("text"), f"'{AGENT}'")
    got = df.selectExpr("*", f"{robots.admits('path', rules)} AS got").collect()
    assert [r.got for r in got] == [r.want for r in got], [r for r in got if r.got != r.want]


def test_directive_rows(spark):
    text = "Allow: /lost\nUser-agent: a\nUser-agent: b # x\nAllow:\nDisallow:\nDisallow: /d\nFoo: 1\nAllow: /e"
    df = spark.createDataFrame([("s", text)], "site STRING, text STRING")
    rows = directives(df).orderBy("group_no", "seq").collect()
    assert [tuple(r) for r in rows] == [
        ("s", 2, "b", 1, "allow", ""),
        ("s", 2, "b", 2, "disallow", "/d"),
        ("s", 2, "b", 3, "allow", "/e"),
    ]


LISTS = [
    # text, allowed, disallowed, delay
    ("User-agent: *\nAllow:\nAllow: /a\nDisallow:\nDisallow: /d", ["", "/a"], ["/d"], None),
    ("User-agent: foo  agent\nDisallow: /d\nCrawl-delay: 2", [], ["/d"], 2.0),
    ("User-agent: foo bar\nDisallow: /d", [], [], None),
    ("User-agent: *\nDisallow: /1\nUser-agent: x\nDisallow: /2\nUser-agent: test\nDisallow: /3",
     [], ["/1", "/3"], None),
    ("User-agent: *\nCrawl-delay: 1.5\nCrawl-delay: soon\n", [], [], 1.5),
    ("User-agent: *\nCrawl-delay: 1\nCrawl-delay: 1e1", [], [], 10.0),
    ("User-agent: *\nCrawl-delay: 1d", [], [], None),
    ("User-agent\nUser-agent: *\nUser-agent\nDisallow: /d", [], ["/d"], None),
    ("Disallow: /lost", [], [], None),
    ("", [], [], None),
]


@pytest.mark.parametrize("text, allowed, disallowed, delay", LISTS)
def test_lists(spark, text, allowed, disallowed, delay):
    df = spark.createDataFrame([(text,)], "text STRING")
    r = df.select(F.expr(robots.agent_rules("text", f"'{AGENT}'")).alias("r")).head().r
    assert (r.allowed, r.disallowed, r.crawl_delay) == (allowed, disallowed, delay)


def test_list_rows(spark):
    df = spark.createDataFrame(
        [("s", "User-agent: *\nAllow: /a\nDisallow: /d\nDisallow: /e\nCrawl-delay: 3")],
        "site STRING, text STRING",
    )
    rows = rule_lists(df, f"'{AGENT}'").collect()
    assert sorted(map(tuple, rows)) == [
        ("s", "allow", 0, "/a", 3.0),
        ("s", "disallow", 0, "/d", 3.0),
        ("s", "disallow", 1, "/e", 3.0),
    ]


def test_site_without_file_has_no_rules(spark):
    sites = spark.createDataFrame([("s", AGENT)], "site STRING, user_agent STRING")
    files = spark.createDataFrame([], "site STRING, text STRING")
    assert site_rules(sites, files).head().rules is None
