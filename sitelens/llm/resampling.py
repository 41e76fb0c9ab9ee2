"""Importance resampling towards a target: documents that read like the target are drawn.

Features are runs of words, folded into buckets by crc32. A bucket's gain is the scaled
log ratio of its smoothed share in the target to that in the documents; a document's
weight is the floored mean gain of its features. Gumbel noise from a hash of the id turns
"highest scores" into a draw without replacement by weight; a rerun draws the same.

Two Arrow passes over the texts. In each batch the n-grams are interned in an
open-addressed NumPy table: xxhash64 gives the first slot, equal hashes are verified byte
by byte, and a slot stores the n-gram's bucket and its count, so that crc32 runs once per
distinct n-gram. The first pass adds counts of slots up by bucket, the second gathers
gains by the slot ids of the occurrences. What travels is one row per task and bucket, and
one slim row per document. Ranks come from range partitions of the rows near the top.

Defined cases. A null text is empty; a document without features has weight 0. A row
without doc_id takes part under the text ``<seed>:``. Repeated rows are documents of
their own and may be drawn each. Ties go to the smaller doc_id, no id last. Without
target rows all targets are 0; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import prepared
from sitelens.operators.ranking import number_by_order
from sitelens.session import materialize

# Executors get these functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A word is a run of digits, a-z and anything beyond ASCII. In UTF-8 all
#: bytes of a character beyond ASCII lie from 0x80 on.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

# Longer n-grams are compared as slices, shorter ones column by column.
_LONG = 32
# Width of the score bins that bound the rows to rank.
_BIN = 1000


class Grams:
    """N-grams of a batch of texts: byte ranges of one buffer, in order of texts."""

    def __init__(self, texts: list[bytes | None], longest: int):
        joined = b"\0".join(t or b"" for t in texts) + b"\0"
        raw = _LOWER[np.frombuffer(joined, np.uint8)]
        inside = _IN_WORD[raw]
        after = np.concatenate([[False], inside[:-1]])
        # Words and the single blank behind each; what else lies between them goes.
        kept = inside | after
        self.data = np.where(inside, raw, np.uint8(32))[kept]
        place = np.cumsum(kept) - 1
        first = np.flatnonzero(inside & ~after)
        starts, ends = place[first], place[np.flatnonzero(~inside & after)]
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        #: Word ``i`` belongs to text ``text``; ``bounds`` are the first words of the texts.
        self.bounds = np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes)]))
        self.n_words = np.diff(self.bounds)
        text = np.repeat(np.arange(len(texts)), self.n_words)
        parts = []
        for n in range(1, longest + 1):
            at = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1]) if len(text) >= n else np.zeros(0, int)
            parts.append((starts[at], ends[at + n - 1], text[at]))
        self.start, self.end, self.text = (np.concatenate(c) for c in zip(*parts))
        self.n_features = np.bincount(self.text, minlength=len(texts))


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the byte ranges of equal ``size`` at ``a`` and ``b`` hold the same."""
    same = np.ones(len(a), bool)
    live = np.flatnonzero(size <= _LONG)
    for k in range(_LONG):
        live = live[size[live] > k]
        if not len(live):
            break
        differ = data[a[live] + k] != data[b[live] + k]
        same[live[differ]] = False
        live = live[~differ]
    for i in np.flatnonzero(size > _LONG).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return same


class Interned:
    """Open-addressed table of a batch's n-grams.

    ``slots`` has the slot of every occurrence; per slot, ``bucket`` and ``count`` are
    those of the n-gram that holds it.
    """

    def __init__(self, grams: Grams, buckets: int, hashing=xxhash.xxh64_intdigest):
        buffer, n = grams.data.tobytes(), len(grams.start)
        ranges = list(zip(grams.start.tolist(), grams.end.tolist()))
        hashes = np.fromiter((hashing(buffer[s:e]) for s, e in ranges), np.uint64, n)
        size = grams.end - grams.start
        mask = (1 << max(4, (2 * n).bit_length())) - 1
        holder = np.full(mask + 1, -1, np.int64)
        self.slots = (hashes & np.uint64(mask)).astype(np.int64)
        pending = np.arange(n)
        while len(pending):
            at = self.slots[pending]
            free = holder[at] < 0
            holder[at[free]] = pending[free]  # of several, one stays
            held = holder[at]
            same = (hashes[held] == hashes[pending]) & (size[held] == size[pending])
            check = np.flatnonzero(same & (held != pending))
            one, two = held[check], pending[check]
            same[check] = _same_bytes(grams.data, grams.start[one], grams.start[two], size[one])
            pending = pending[~same]
            self.slots[pending] = (self.slots[pending] + 1) & mask
        self.bucket = np.zeros(mask + 1, np.int64)
        used = np.flatnonzero(holder >= 0)
        self.bucket[used] = [zlib.crc32(buffer[s:e]) % buckets for s, e in (ranges[i] for i in holder[used].tolist())]
        self.count = np.bincount(self.slots, minlength=mask + 1)


def feature_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: how many features of the one text column fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            table = Interned(Grams(batch.column(0).to_pylist(), longest), buckets)
            np.add.at(total, table.bucket, table.count)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    counted = texts.mapInArrow(run, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    """At most ``buckets`` rows, a parameter, come to the driver."""
    dense = [0] * buckets
    for row in counts.collect():
        dense[row["bucket"]] = row["n"]
    return dense


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Scaled, floored log ratio of the target's smoothed share of a bucket to the source's."""
    buckets, total, wanted = len(source), float(sum(source)), float(sum(target))
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (total + buckets) / ((s + 1.0) * (wanted + buckets))))
            for s, t in zip(source, target)
        ],
        np.int64,
    )


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def scored(documents: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = Grams(batch.column(1).to_pylist(), longest)
            table = Interned(grams, buckets)
            by_slot = gain[table.bucket]
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, grams.text, by_slot[table.slots])
            weight = total // np.maximum(grams.n_features, 1)
            drawn = np.array([noise(seed, d) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(grams.n_words.astype(np.int64)),
                    pa.array(grams.n_features.astype(np.int64)),
                    pa.array(weight),
                    pa.array(weight + drawn),
                ],
                [c.split()[0] for c in _SCORED.split(", ")],
            )

    return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, _SCORED)


def resampled(
    documents: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    least_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank of the drawn ones.

    ``target`` has a ``text``. Of the documents with ``least_words`` words, ``percent`` in
    a hundred are drawn.
    """
    prepared(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    source, wanted = (
        _dense(feature_counts(t.select(F.col("text").cast("binary")), longest, buckets), buckets) for t in (texts, target)
    )
    rows = materialize(scored(texts, gains(source, wanted), longest, seed), "scored")
    rows = rows.withColumn("bin", F.expr(f"if(n_words >= {least_words}, floor(score / {_BIN}), NULL)"))
    # Scores are logarithms of 64-bit counts: a few hundred bins, whatever the input.
    bins = sorted(((r["bin"], r["n"]) for r in rows.filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n")).collect()), reverse=True)
    to_draw = percent * sum(n for _, n in bins) // 100
    lowest, above = 1 << 62, 0
    for at, n in bins:
        if above >= to_draw:
            break
        lowest, above = at, above + n
    near_top = f"coalesce(bin >= {lowest}, false)"
    ranked = number_by_order(
        rows.filter(near_top).selectExpr("*", "-score AS place", "doc_id IS NULL AS nameless"),
        [],
        ["place", "nameless", "doc_id"],
        "rank",
    )
    columns = ("doc_id", "n_features", "weight", "score")
    drawn = ranked.select(*columns, F.expr(f"if(rank <= {to_draw}, rank, NULL)").cast("bigint").alias("rank"))
    return drawn.unionByName(
        rows.filter(f"NOT {near_top}").select(*columns, F.lit(None).cast("bigint").alias("rank"))
    )
