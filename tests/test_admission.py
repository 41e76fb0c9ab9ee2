"""Verdicts by prefix index against the plain rule: the last rule that prefixes the path."""

import random

from sitelens.operators import admission

RULES = "site STRING, rules ARRAY<STRUCT<directive: STRING, prefix: STRING>>"


def plain(path, rules):
    hits = [d for d, p in rules if p and path.startswith(p)]
    return not hits or hits[-1] == "allow"


def verdicts(spark, paths, rules):
    rows = spark.createDataFrame([(s, list(r) if r is not None else None) for s, r in rules.items()], RULES)
    given = spark.createDataFrame(paths, "site STRING, path STRING")
    got = {(r.site, r.path): r.allowed for r in admission.path_verdicts(given.distinct(), rows).collect()}
    return {(s, p): got.get((s, p), True) for s, p in paths}


def test_the_last_rule_decides(spark):
    rules = {
        "a": [("disallow", "/"), ("allow", "/x"), ("disallow", "/x/y"), ("allow", "/x/y"), ("allow", "")],
        "b": [("allow", "/é"), ("disallow", "/é/ü"), ("disallow", "/p?q=")],
        "none": None,
        "empty": [],
    }
    paths = [(s, p) for s in rules for p in ("", "/", "/x", "/x/y/z", "/é/ü", "/é", "/p?q=1", "/p?", "\U0001f600")]
    assert verdicts(spark, paths, rules) == {(s, p): plain(p, rules[s] or []) for s, p in paths}


def test_a_hundred_thousand_rules_of_one_host(spark):
    rnd = random.Random(1)

    def path(deep):
        return "/" + "/".join(str(rnd.randrange(30)) for _ in range(rnd.randrange(1, deep)))

    rules = {"hot": [(rnd.choice(("allow", "disallow")), path(5)) for _ in range(100_000)], "cold": [("disallow", "/1")]}
    paths = sorted({(s, path(7)) for s in ("hot", "cold", "unknown") for _ in range(1500)})
    # A rule's last place is all that counts, so the plain check can look prefixes up.
    last = {p: (i, d) for i, (d, p) in enumerate(rules["hot"])}

    def want(site, p):
        if site != "hot":
            return plain(p, rules.get(site, []))
        hits = [last[p[:n]] for n in range(1, len(p) + 1) if p[:n] in last]
        return not hits or max(hits)[1] == "allow"

    got = verdicts(spark, paths, rules)
    assert got == {(s, p): want(s, p) for s, p in paths}
    assert len(set(got.values())) == 2


def test_links_of_pages(spark):
    html = "<a href='/a/b'><a href='/a'><a href='/a/b'><a href='http://other/a'>"
    pages = spark.createDataFrame([(1, "s", "http://s/", html)], "page_id INT, site STRING, url STRING, html STRING")
    rules = spark.createDataFrame([("s", [("disallow", "/a/")])], RULES)
    got = sorted(map(tuple, admission.link_verdicts(pages, rules).collect()))
    assert got == [(1, 0, "http://s/a/b", False), (1, 1, "http://s/a", True), (1, 2, "http://s/a/b", False)]


def test_rules_are_never_scanned_per_link(spark):
    """Paths and rules meet in hash joins on site and prefix; no expression walks the rules."""
    rows = spark.createDataFrame([("s", [("disallow", "/a")])], RULES)
    paths = spark.createDataFrame([("s", "/a")], "site STRING, path STRING")
    text = admission.path_verdicts(paths, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, ((site" in text and "prefix" in text.split("Join Inner")[1] and "startswith" not in text.lower()
