"""Line deduplication by range-partitioned hashes and per-document keep bitmaps.

Lines travel as 128-bit hashes with document and position. A range partitioning by
hash and falling document id, sorted inside, lets a task stream each hash from its
largest document on; a hash held by a third of all documents simply spans many
partitions. Only the hash at either edge of a partition can be incomplete: its
partial counts, two rows a partition, are added up and settle the lines left open.
The result is one compressed bitmap per touched document; texts are only met again
when the bitmaps are applied.

Defined cases. A null or empty text is one empty line. A line's key is the line
without ASCII blanks at its ends, A-Z in lower case. Keys of at least ``min_chars``
code points found in at least ``min_docs`` documents lose all lines but those of
the largest ``doc_id`` that holds them. Rows repeated under one id are one document.
Rows without id count as no document and keep all lines. A table without lines
gives no bitmaps. Further columns are kept; ``n_lines, n_dropped`` are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sitelens.llm.common import BLANK, prepared
from sitelens.session import materialize

_HASHED = "hash binary, doc_id bigint, text_id bigint, pos int"
_FOUND = "kind int, hash binary, doc_id bigint, text_id bigint, pos int, n_docs bigint"
_DROPPED, _OPEN, _EDGE = 0, 1, 2


def _arrow(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields]
    )


def _hasher(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for pos, line in enumerate(text.split("\n")):
                    key = line.strip(BLANK)
                    if len(key) >= min_chars:
                        rows.append((xxhash.xxh3_128_digest(key.encode().lower()), doc_id, text_id, pos))
            yield _arrow(rows, _HASHED)

    return run


def _stream(min_docs: int):
    """Settle the hashes of one sorted partition; the first and the last one stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, doc, n_docs, largest = None, True, None, 0, None
        held: list[tuple] = []  # lines after the largest document's, before min_docs are seen
        out: list[tuple] = []

        for batch in batches:
            for key, doc_id, text_id, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if key != group:
                    if group is not None and first:
                        out.append((_EDGE, group, largest, None, None, n_docs))
                        first = False
                    group, doc, n_docs, largest, held = key, None, 0, doc_id, []
                if doc_id != doc:
                    doc, n_docs = doc_id, n_docs + 1
                    if n_docs == min_docs:
                        out.extend((_DROPPED, None, d, t, p, None) for d, t, p in held)
                        held = []
                if first:
                    out.append((_OPEN, key, doc_id, text_id, pos, None))
                elif doc_id == largest:
                    continue
                elif n_docs >= min_docs:
                    out.append((_DROPPED, None, doc_id, text_id, pos, None))
                else:
                    held.append((doc_id, text_id, pos))
            yield _arrow(out, _FOUND)
            out.clear()
        if group is not None:
            out.append((_EDGE, group, largest, None, None, n_docs))
            out.extend((_OPEN, group, d, t, p, None) for d, t, p in held)
            yield _arrow(out, _FOUND)

    return run


def keep_bitmaps(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``doc_id, text_id, keep``: a bitmap per text that loses lines, up to its last loss.

    ``text_id`` is the text's hash; a set bit keeps the line of its position. Bits
    are packed from the low end and deflated.
    """
    prepared(documents.sparkSession)
    texts = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_id"), "text"
    )
    hashed = materialize(texts.mapInArrow(_hasher(min_chars), _HASHED), "line-hashes")
    # Written once: the range bounds and both readings below see the same rows.
    found = materialize(
        hashed.repartitionByRange(F.col("hash"), F.col("doc_id").desc())
        .sortWithinPartitions(F.col("hash"), F.col("doc_id").desc(), F.col("text_id"), F.col("pos"))
        .mapInArrow(_stream(min_docs), _FOUND),
        "line-runs",
    )
    # At most two rows a partition, whatever the data holds.
    edges = (
        found.filter(F.col("kind") == _EDGE)
        .groupBy("hash")
        .agg(F.sum("n_docs").alias("n"), F.max("doc_id").alias("largest"))
        .filter(F.col("n") >= min_docs)
    )
    settled = (
        found.filter(F.col("kind") == _OPEN)
        .join(F.broadcast(edges), "hash")
        .filter("doc_id < largest")
        .select("doc_id", "text_id", "pos")
    )
    dropped = found.filter(F.col("kind") == _DROPPED).select("doc_id", "text_id", "pos")
    return (
        dropped.unionByName(settled)
        .groupBy("doc_id", "text_id")
        .agg(F.collect_set("pos").alias("pos"))
        .select("doc_id", "text_id", _pack("pos").alias("keep"))
    )


@F.pandas_udf(T.BinaryType())
def _pack(positions: pd.Series) -> pd.Series:
    def one(at) -> bytes:
        bits = np.ones(max(at) // 8 * 8 + 8, np.uint8)  # whole bytes: what pads them is kept
        bits[np.asarray(at)] = 0
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes())

    return positions.map(one)


def unpack(keep: bytes, n: int) -> np.ndarray:
    """Keep flags of ``n`` lines; lines beyond the bitmap are kept."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[:n]
    return np.concatenate([bits, np.ones(n - len(bits), np.uint8)]).astype(bool)


_KEPT = T.StructType().add("text", "string").add("n_lines", "long").add("n_dropped", "long")


@F.pandas_udf(_KEPT)
def _kept(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
    rows = []
    for text, keep in zip(texts, keeps):
        lines = (text or "").split("\n")
        stay = lines if keep is None else [x for x, k in zip(lines, unpack(keep, len(lines))) if k]
        rows.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``documents`` with their kept text, and ``n_lines, n_dropped``.

    A null text becomes an empty one.
    """
    prepared(documents.sparkSession)
    mine = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"), "keep")
    columns = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    joined = documents.select(F.struct(*columns).alias("_row")).join(
        mine.select("_doc", "_text", F.col("keep").alias("_keep")),
        (F.col("_row.doc_id") == F.col("_doc")) & (F.xxhash64("_row.text") == F.col("_text")),
        "left",
    )
    return joined.withColumn("_kept", _kept("_row.text", "_keep")).select(
        *(F.col("_kept.text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns),
        "_kept.n_lines",
        "_kept.n_dropped",
    )
