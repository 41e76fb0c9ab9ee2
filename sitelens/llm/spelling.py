"""Spelling variants: words one edit apart, grouped under their commonest form.

Asymmetric q-chunks. Of two words that may be near, the shorter one (of equal length, the
smaller one) contributes two disjoint chunks, its first and its second half of
``q = length div 2`` code points; the other contributes all its positional q-grams. One
inserted, deleted or replaced code point lies in at most one of the two chunks, so the
other is a gram of the longer word, at its own place or one further. Chunks and grams are
joined by place and text, and the pair is verified inside the join: rows that leave it
are near pairs, of which a word has at most as many as it has places times letters.

Words are counted in one Arrow pass with a bounded table per task, then by Spark; only
the vocabulary is joined. Roots are found by doubling steps along the forms: a form is at
least twice as frequent as its word, so chains are short and have no loops.

Defined cases. A null text has no words; a row without doc_id counts under the text
``:<run>``. Repeated rows count as often as they occur. Words without a near one have
``n_near`` 0 and are their own root. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import prepared
from sitelens.session import materialize

# Executors get these functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Letters of a run, and how often and which damaged runs are read.
_RUN = re.compile("[a-zÀ-ÿ]+")
_DAMAGE_EVERY = 97
# Distinct words that a task holds before it hands them on.
_HELD = 200_000


def runs(text: str | None) -> Counter:
    """Letter runs of a text with their counts, only A-Z in lower case."""
    # On UTF-8 bytes lower() changes ASCII letters alone.
    return Counter(_RUN.findall((text or "").encode().lower().decode()))


def damaged(doc_id: object, run: str, every: int = _DAMAGE_EVERY) -> str:
    """The run as read in this document: some lose the code point that their hash points at."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least_length: int):
    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for found, n in runs(text).items():
                    word = damaged(doc_id, found)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > _HELD:
                    yield emit(counts)
                    counts = Counter()
        yield emit(counts)

    return run


def vocabulary(documents: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: the runs of all texts, as read, with their number."""
    prepared(documents.sparkSession)
    counted = documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _counted(least_length), "word string, n bigint"
    )
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of ``word, n`` rows one edit apart, once; ``a`` is the shorter.

    Words must be distinct and have at least four code points, so that a chunk has two.
    """
    # One edit changes at most two letters of the set of letters, here bits of a number.
    letters = "aggregate(split(word, ''), 0L, (m, c) -> m | shiftleft(1L, ascii(c) & 63))"
    sized = words.selectExpr("word", "n", "length(word) AS size", f"{letters} AS letters")
    halves = sized.selectExpr(
        "word AS a", "n AS n_a", "size AS size_a", "letters AS letters_a", "cast(size div 2 AS int) AS q",
        "explode(array(0, cast(size div 2 AS int))) AS own",
    ).selectExpr(
        "a", "n_a", "size_a", "letters_a", "q", "substr(a, own + 1, q) AS gram", "explode(array(own, own + 1)) AS place"
    )
    # The chunks of a word of this length, or one less.
    grams = sized.selectExpr(
        "word AS b", "n AS n_b", "size AS size_b", "letters AS letters_b", "explode(array_distinct(array(cast(size div 2 AS int), cast((size - 1) div 2 AS int)))) AS q"
    ).selectExpr("b", "n_b", "size_b", "letters_b", "q", "explode(sequence(0, size_b - q)) AS place").selectExpr(
        "b", "n_b", "size_b", "letters_b", "q", "place", "substr(b, place + 1, q) AS gram"
    )
    near = """size_b - size_a BETWEEN 0 AND 1 AND bit_count(letters_a ^ letters_b) <= 2
              AND (size_a < size_b OR a < b) AND levenshtein(a, b, 1) = 1"""
    met = halves.join(grams, ["q", "place", "gram"]).filter(near)
    return met.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


def _roots(words: DataFrame) -> DataFrame:
    """``word, root`` for the words with a form: the last one reached from it."""
    known = materialize(words.filter("form IS NOT NULL").selectExpr("word", "form AS root"), "roots")
    while True:
        ahead = known.selectExpr("word AS root", "root AS further")
        stepped = materialize(
            known.join(ahead, "root", "left").selectExpr("word", "coalesce(further, root) AS root", "further"), "roots"
        )
        known = stepped.select("word", "root")
        if stepped.filter("further IS NOT NULL").isEmpty():
            return known


def grouped(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each of the distinct ``word, n``.

    The form is the near word of largest ``n``, the smallest of several in code-point
    order, if it is at least twice as frequent.
    """
    words = materialize(words, "words")
    pairs = materialize(near_pairs(words), "near-words")
    both = pairs.selectExpr("a AS word", "struct(-n_b AS rest, b AS near) AS other").unionByName(
        pairs.selectExpr("b AS word", "struct(-n_a AS rest, a AS near) AS other")
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    formed = materialize(
        words.join(best, "word", "left").selectExpr(
            "word",
            "n",
            "coalesce(n_near, cast(0 AS bigint)) AS n_near",
            "if(-best.rest >= 2 * n, best.near, NULL) AS form",
            "if(-best.rest >= 2 * n, -best.rest, NULL) AS form_n",
        ),
        "forms",
    )
    return formed.join(_roots(formed), "word", "left").selectExpr(
        "word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n"
    )
