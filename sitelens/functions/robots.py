"""robots.txt as native expressions: two dialects and the admission verdict.

A file is cut into blocks at its ``User-agent`` lines with one split, so group
numbers need no window over lines and no shuffle: one row per file stays one
row per file.
"""

from __future__ import annotations

from sitelens.functions.sql import each, keep, let, raw, struct
from sitelens.functions.text import BLANK, LINE_BREAK, SPACE, lines, strip

_LINE_START = rf"(?:^|(?<={LINE_BREAK}))"
_AGENT_LINE = rf"(?i){_LINE_START}(?={BLANK}*user-agent{BLANK}*(?::|#|{LINE_BREAK}|\z))"
_AGENT_LINE_WITH_VALUE = rf"(?i){_LINE_START}(?={BLANK}*user-agent{BLANK}*:)"

# What Python's float() accepts, digit separators aside.
_FLOAT = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def _directives(block: str) -> str:
    """Structs of key, value and whether the line had a colon; comments cut."""
    texts = each(lines(block), lambda l: strip(f"substring_index({l}, '#', 1)"))
    return each(
        texts,
        lambda l: struct(
            key=f"lower({strip(f"substring_index({l}, ':', 1)")})",
            value=f"if(contains({l}, ':'), {strip(f"substr({l}, instr({l}, ':') + 1)")}, '')",
            colon=f"contains({l}, ':')",
        ),
    )


def groups(text: str) -> str:
    """Groups in file order: ``agent`` and ``rules`` of ``directive`` and ``prefix``.

    Every ``User-agent`` line opens a group of its own. Directives before any
    agent and empty ``Disallow`` lines are dropped.
    """
    blocks = each(f"split({text}, {raw(_AGENT_LINE)})", _directives)
    opened = keep(blocks, lambda b: f"{b}[0].key = 'user-agent'")
    return each(
        opened,
        lambda b: struct(
            agent=f"{b}[0].value",
            rules=each(
                keep(
                    b,
                    lambda d: (
                        f"{d}.key = 'allow' OR ({d}.key = 'disallow' AND {d}.value <> '')"
                    ),
                ),
                lambda d: struct(directive=f"{d}.key", prefix=f"{d}.value"),
            ),
        ),
    )


def rules_for(group_array: str, user_agent: str) -> str:
    """Rules of the first group for everyone or whose agent begins the user agent."""
    matching = keep(
        group_array,
        lambda g: f"{g}.agent = '*' OR startswith(lower({user_agent}), lower({g}.agent))",
    )
    return f"try_element_at({matching}, 1).rules"


def admits(path: str, rules: str) -> str:
    """The last rule that is a literal prefix of the path decides; none admits."""
    hits = keep(rules, lambda r: f"{r}.prefix <> '' AND startswith({path}, {r}.prefix)")
    return f"coalesce(try_element_at({hits}, -1).directive = 'allow', true)"


def agent_rules(text: str, user_agent: str) -> str:
    """Struct of ``allowed``, ``disallowed`` and ``crawl_delay`` for a user agent.

    One line may name several agents, all matching blocks count, and an agent
    matches anywhere in the user agent. The last readable delay wins.
    """
    blocks = each(
        f"split({text}, {raw(_AGENT_LINE_WITH_VALUE)})",
        lambda b: keep(_directives(b), lambda d: f"{d}.colon"),
    )

    def matches(block: str) -> str:
        agents = keep(f"split({block}[0].value, {raw(f'{SPACE}+')})", lambda a: f"{a} <> ''")
        hit = f"a = '*' OR contains(lower({user_agent}), lower(a))"
        opened = f"size({block}) > 0 AND {block}[0].key = 'user-agent'"
        return f"if({opened}, exists({agents}, a -> {hit}), false)"

    def collected(found: str) -> str:
        def values(test: str) -> str:
            return each(keep(found, lambda d: test.format(d=d)), lambda d: f"{d}.value")

        delays = values("{d}.key = 'crawl-delay' AND {d}.value RLIKE " + _braced(raw(_FLOAT)))
        return struct(
            allowed=values("{d}.key = 'allow'"),
            disallowed=values("{d}.key = 'disallow' AND {d}.value <> ''"),
            crawl_delay=f"cast(try_element_at({delays}, -1) AS double)",
        )

    return let(f"flatten({keep(blocks, matches)})", collected)


def _braced(literal: str) -> str:
    return literal.replace("{", "{{").replace("}", "}}")
