"""Hidden-resource discovery over stored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelens.functions import urls
from sitelens.functions.sql import let, raw


def _word_path(word: str) -> str:
    """What a word adds below ``base/``: cut at query, fragment and params."""
    cut = f"regexp_replace({urls.clean(word)}, {raw(r'(?s)[?#].*|;[^/?#]*(?:[?#].*)?\z')}, '')"
    return let(
        cut,
        lambda w: (
            f"if({w} = '' OR endswith({w}, '/') OR regexp_replace({w}, {raw(r'(?:/+\.)+\z')}, '')"
            f" RLIKE {raw(r'[^/]\.[^./]+\z')}, {w}, concat({w}, '/'))"
        ),
    )


def hidden_resources(bases: DataFrame, words: DataFrame, responses: DataFrame) -> DataFrame:
    """Probed URLs that answered with success: ``base, url, status`` and the answer.

    Every base is probed with every word, repeated words again. Instead of
    building all pairs, each successful answer is cut at its slashes into a base
    and a word, and both are looked up; work grows with the answers, not with
    bases times words. ``bases``: ``base`` without query or fragment;
    ``words``: ``word, n``.
    """
    probes = (
        words.selectExpr(f"{_word_path('word')} AS tail", "n")
        .groupBy("tail")
        .agg(F.sum("n").alias("n"))
    )
    # A probe has one answer: of several stored ones, that with the lowest status.
    rest = [c for c in responses.columns if c not in ("url", "status")]
    answered = (
        responses.filter(urls.is_success("status"))
        .groupBy(F.expr(urls.directory_form_of("url")).alias("url"))
        .agg(F.min(F.struct("status", *rest)).alias("answer"))
        .select("url", "answer.*")
        .select(*responses.columns)
    )
    cuts = answered.selectExpr(
        "*",
        "explode(if(size(split(url, '/')) > 3,"
        " sequence(3, size(split(url, '/')) - 1), array())) AS cut",
    ).selectExpr(
        *answered.columns,
        "substring_index(url, '/', cut) AS base",
        "substr(url, length(substring_index(url, '/', cut)) + 2) AS tail",
    )
    asked = bases.select("base").distinct()
    return (
        cuts.join(asked, "base")
        .join(probes, "tail")
        .selectExpr("base", *answered.columns, "explode(sequence(1, n)) AS copy")
        .drop("copy")
    )
