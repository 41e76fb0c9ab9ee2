"""Robots verdict for every internal link, by an index of rule prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelens.functions.sql import each, keep
from sitelens.operators.links import crawl_base, internal
from sitelens.session import materialize


def rule_index(rules_by_site: DataFrame) -> DataFrame:
    """``site, prefix, seq, directive``: the last rule of each site with each prefix."""
    numbered = rules_by_site.selectExpr("site", "posexplode(rules) AS (seq, rule)")
    return (
        numbered.selectExpr("site", "seq", "rule.directive AS directive", "rule.prefix AS prefix")
        .filter("prefix <> ''")
        .groupBy("site", "prefix")
        .agg(F.max("seq").alias("seq"), F.max_by("directive", "seq").alias("directive"))
    )


def path_verdicts(paths: DataFrame, rules_by_site: DataFrame) -> DataFrame:
    """``site, path, allowed`` of the distinct ``site, path`` rows that a rule prefixes.

    A path is cut at each length that prefixes of its site's rules have, and the cuts are
    looked up by hash; of the rules found the last one decides. So the work per path
    grows with the number of lengths, never with that of the rules.
    """
    index = rule_index(rules_by_site)
    lengths = index.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cuts = each(keep("lengths", lambda n: f"{n} <= length(path)"), lambda n: f"substr(path, 1, {n})")
    found = paths.join(lengths, "site").selectExpr("site", "path", f"explode({cuts}) AS prefix")
    return (
        found.join(index, ["site", "prefix"])
        .groupBy("site", "path")
        .agg((F.max_by("directive", "seq") == "allow").alias("allowed"))
    )


def link_verdicts(pages: DataFrame, rules_by_site: DataFrame) -> DataFrame:
    """``page_id, pos, link, allowed`` for each internal link of ``pages``.

    ``pages`` carry ``site``. A verdict depends on the site and the path alone, so it is
    worked out once for each of these and joined to the links; links that no rule
    prefixes are admitted. Links are written once, slim, and read for both sides.
    """
    links = materialize(
        crawl_base(pages, "site")
        .selectExpr("page_id", "site", f"explode({internal('hrefs', 'norm')}) AS l")
        .selectExpr("page_id", "site", "l.pos", "l.link", "l.parts.path AS path"),
        "links",
    )
    verdicts = path_verdicts(links.select("site", "path").distinct(), rules_by_site.select("site", "rules"))
    return links.join(verdicts, ["site", "path"], "left").selectExpr(
        "page_id", "pos", "link", "coalesce(allowed, true) AS allowed"
    )
