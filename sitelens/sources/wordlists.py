"""Wordlist scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.functions.text import lines, strip


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of wordlist files; a missing file is an error when planned."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def entries(raw_lines: DataFrame) -> DataFrame:
    """Stripped, non-blank words, one row per occurrence."""
    return (
        raw_lines.selectExpr(f"explode({lines('line')}) AS line")
        .selectExpr(f"{strip('line')} AS word")
        .filter("word <> ''")
    )


def multiplicities(words: DataFrame) -> DataFrame:
    """Each word once with its number of occurrences."""
    return words.groupBy("word").count().withColumnRenamed("count", "n")
