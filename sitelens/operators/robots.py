"""robots.txt tables and the admission of links."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitelens.functions import robots as rules
from sitelens.functions.sql import each_indexed, let, struct


def directives(files: DataFrame) -> DataFrame:
    """One row per directive of each group, groups and directives in file order."""
    numbered = each_indexed(
        rules.groups("text"), lambda g, i: struct(group_no=f"{i} + 1", agent=f"{g}.agent", rules=f"{g}.rules")
    )
    return (
        files.selectExpr("site", f"explode({numbered}) AS g")
        .selectExpr("site", "g.group_no", "g.agent", "posexplode(g.rules) AS (at, rule)")
        .selectExpr(
            "site",
            "group_no",
            "agent",
            "at + 1 AS seq",
            "rule.directive AS directive",
            "rule.prefix AS value",
        )
    )


def rule_lists(files: DataFrame, user_agent: str) -> DataFrame:
    """Allowed and disallowed prefixes for a user agent, one row per prefix.

    ``user_agent`` is an expression. A file without any prefix gives no row.
    """

    def listed(kind: str, values: str) -> str:
        return each_indexed(
            values, lambda v, i: struct(kind=f"'{kind}'", pos=i, value=v)
        )

    both = let(
        rules.agent_rules("text", user_agent),
        lambda r: struct(
            entries=f"concat({listed('allow', f'{r}.allowed')}, {listed('disallow', f'{r}.disallowed')})",
            delay=f"{r}.crawl_delay",
        ),
    )
    return (
        files.selectExpr("site", f"{both} AS r")
        .selectExpr("site", "explode(r.entries) AS e", "r.delay AS crawl_delay")
        .selectExpr("site", "e.kind", "e.pos", "e.value", "crawl_delay")
    )


def site_rules(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests with ``rules``, the directives that hold for their user agent.

    One slim row per site; NULL rules where there is no file or no group.
    """
    return requests.join(files, "site", "left").selectExpr(
        *requests.columns, f"{rules.rules_for(rules.groups('text'), 'user_agent')} AS rules"
    )
