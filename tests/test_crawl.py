"""Crawl scenarios, and what must hold on random sites."""

import random

import pytest

from sitelens.operators.crawl import crawl
from sitelens.operators.links import broken_links

AGENT = "TestAgent/1.0"
ALLOW_ALL = "User-agent: *\nDisallow:"


def run(spark, site_pages, robots, depth, max_pages=1000, base="http://s.example"):
    pages = [(i, url, html) for i, (url, html) in enumerate(site_pages)]
    snapshot = spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING")
    requests = spark.createDataFrame(
        [("s", base, depth, max_pages, AGENT)],
        "site STRING, base_url STRING, max_depth INT, max_pages BIGINT, user_agent STRING",
    )
    files = spark.createDataFrame([("s", robots)], "site STRING, text STRING")
    rows = crawl(requests, snapshot, files).collect()
    assert len({r.url for r in rows}) == len(rows)
    return {r.url.removeprefix(base): r.depth for r in rows}


def site(**links):
    return [
        ("http://s.example/" + name.removeprefix("root"),
         "".join(f'<a href="{t}">x</a>' for t in targets))
        for name, targets in links.items()
    ]


def test_chain_stops_at_a_page_that_timed_out(spark):
    pages = site(root=["/page1"], page1=["/page2"], page2=["/page3"])
    assert run(spark, pages, ALLOW_ALL, 3) == {"": 0, "/page1": 1, "/page2": 2}


def test_robots_block(spark):
    pages = site(root=["/page1"], page1=[])
    robots = f"User-agent: {AGENT}\nDisallow: /page1"
    assert run(spark, pages, robots, 1) == {"": 0}


def test_depth_zero(spark):
    assert run(spark, site(root=["/page1"], page1=[]), ALLOW_ALL, 0) == {"": 0}


def test_fan_out(spark):
    names = [f"/page{i}" for i in range(1, 201)]
    pages = site(root=names) + [("http://s.example" + n, "<h1>Page</h1>") for n in names]
    assert len(run(spark, pages, ALLOW_ALL, 1)) == 201


def test_missing_page_is_a_broken_link(spark):
    pages = site(root=["/missing", "/missing/", "/missing?x"])
    assert run(spark, pages, ALLOW_ALL, 1) == {"": 0}
    df = spark.createDataFrame(
        [(i, u, h, "s") for i, (u, h) in enumerate(pages)],
        "page_id BIGINT, url STRING, html STRING, host STRING",
    )
    assert [tuple(r) for r in broken_links(df, "host").collect()] == [
        ("http://s.example/missing", "s", 1)
    ]


def test_siblings(spark):
    pages = site(root=["/slow1", "/slow2"], slow1=[], slow2=[])
    assert run(spark, pages, ALLOW_ALL, 1) == {"": 0, "/slow1": 1, "/slow2": 1}


def test_budget_admits_half_of_what_is_left(spark):
    names = [f"/p{i}" for i in range(20)]
    pages = site(root=names) + [("http://s.example" + n, "") for n in names]
    got = run(spark, pages, ALLOW_ALL, 1, max_pages=10)
    assert got == {"": 0} | {f"/p{i}": 1 for i in range(5)}


def test_binary_page_is_found_but_not_mined(spark):
    pages = site(root=["/file", "/x"]) + [("http://s.example/file", None), ("http://s.example/x", "")]
    assert run(spark, pages, ALLOW_ALL, 2) == {"": 0, "/file": 1, "/x": 1}


def test_seed_is_not_checked_and_copies_count_once(spark):
    pages = [
        ("http://s.example/", '<a href="/a">first</a>'),
        ("http://s.example", '<a href="/b">second</a>'),
        ("http://s.example/a?x", ""),
        ("http://s.example/b", ""),
    ]
    robots = "User-agent: *\nDisallow: /b"
    assert run(spark, pages, robots, 1) == {"": 0, "/a": 1}


@pytest.mark.parametrize("seed", range(3))
def test_random_sites_together(spark, seed):
    """Without a budget that binds, pages have their shortest distance; with one, levels keep to it."""
    rng = random.Random(seed)
    pages, requests, edges = [], [], {}
    for s in range(12):
        base, names = f"http://s{s}.example", [""] + [f"/n{i}" for i in range(rng.randint(1, 60))]
        edges[s] = {n: [rng.choice(names[1:]) for _ in range(rng.randint(0, 12))] for n in names}
        pages += [
            (1000 * s + i, base + n, "".join(f'<a href="{t}">x</a>' for t in ts))
            for i, (n, ts) in enumerate(edges[s].items())
        ]
        requests.append((f"site{s}", base, 4, 1000 if s % 2 else rng.choice([1, 2, 7, 20]), AGENT))
    got = crawl(
        spark.createDataFrame(
            requests,
            "site STRING, base_url STRING, max_depth INT, max_pages BIGINT, user_agent STRING",
        ),
        spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING"),
        spark.createDataFrame([], "site STRING, text STRING"),
    ).collect()
    for s, (site_name, base, deepest, budget, _) in enumerate(requests):
        depth = {r.url.removeprefix(base): r.depth for r in got if r.site == site_name}
        assert len(depth) == sum(r.site == site_name for r in got) and depth[""] == 0
        for page, d in depth.items():
            # Some page one level up links here; without a budget, none nearer does.
            parents = [depth[p] for p in depth if page in edges[s][p]]
            assert page == "" or d - 1 in parents
            if budget == 1000:
                assert page == "" or d == min(parents) + 1
        if budget == 1000:
            linked = {t for p, d in depth.items() if d < deepest for t in edges[s][p]}
            assert linked <= set(depth)
        sizes = [list(depth.values()).count(d) for d in range(deepest + 1)]
        for d in range(1, deepest + 1):
            assert sizes[d] <= max(0, -(-(budget - sum(sizes[:d])) // 2))


def test_two_sites_on_one_host(spark):
    pages = [(0, "http://s.example/a", '<a href="/b">x</a>'), (1, "http://s.example/b", "")]
    got = crawl(
        spark.createDataFrame(
            [("one", "http://s.example/a", 1, 9, AGENT), ("two", "http://s.example/b", 1, 9, AGENT)],
            "site STRING, base_url STRING, max_depth INT, max_pages BIGINT, user_agent STRING",
        ),
        spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING"),
        spark.createDataFrame([], "site STRING, text STRING"),
    ).collect()
    assert sorted(tuple(r) for r in got) == [
        ("one", 0, "http://s.example/a"),
        ("one", 1, "http://s.example/b"),
        ("two", 0, "http://s.example/b"),
    ]
