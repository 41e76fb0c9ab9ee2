"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments, fewer than the four bits that two
linked fingerprints may differ in: of the three, one differs by at most one bit. Each
segment is indexed under all its one-wildcard variants, one per bit, the bit itself left
out. Two fingerprints whose segments differ by at most one bit share a variant, so the
equality join on variants loses no link; the whole fingerprints are then verified.

* Equal fingerprints are one node, so exact copies cost one row after the first pass.
* A variant's members are those of two segment values, whose counts are known from three
  slim rows a node. Values that many nodes share (groups of near copies) are compared
  first in runs of neighbours, in linear work; that joins most of such a group.
* Then every variant of every node is looked at, pairs inside a component found so far
  passed over. Variants with many members are cut into blocks, and a task takes a pair of
  blocks; those whose members are one component already are not dealt.
* A task gives the links that join two components only, at most one a member, never all
  pairs of a group. Smallest ids come from the components of these links.

The result has a class per document; pairs inside a class are not listed.

Defined cases. Words are split at ASCII blanks, A-Z in lower case; fewer words than a
shingle are one shingle of their own length; a text without words, or null, has the
fingerprint zero and links like any other. Repeated rows, and different texts under one
id, are documents of their own with that id. Rows without id take part; a component's id
is its smallest known one, null if there is none. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import prepared
from sitelens.llm.jaccard import components
from sitelens.session import materialize

# Executors get these functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of a link, and the first bits and widths of the segments.
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_SEED = 42
# Hashes whose bits are counted at once.
_CHUNK = 65_536
# Members of a variant that are compared by shifts of the whole batch; above, one by one.
_SMALL = 32


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the word shingles, repeats included, as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    hashing = xxhash.xxh64_intdigest
    ranges = zip(starts[:n].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((hashing(joined[s:e], _SEED) for s, e in ranges), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, node`` of every document; ``node`` is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "node"])

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id bigint, node bigint")


class Forest:
    """Links that join what was apart: at most one fewer than the nodes they touch."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def top(self, node: int) -> int:
        above = self.above
        while (up := above.get(node, node)) != node:
            above[node] = node = above.get(up, up)
        return node

    def add(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            p, q = self.top(a), self.top(b)
            if p != q:
                self.above[max(p, q)] = min(p, q)
                self.links.append((a, b))


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Unsigned: of a negative number the bits of its absolute value would be counted.
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE


def _in_small(starts: np.ndarray, node: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Pairs of groups by shifts: row ``i`` with the rows behind it in its bucket."""
    bucket = np.cumsum(starts)
    found = [np.zeros((0, 2), np.int64)]
    for shift in range(1, _SMALL):
        at = np.flatnonzero(bucket[shift:] == bucket[:-shift])
        if not len(at):
            break
        at = at[(group[at] != group[at + shift]) & _close(node[at], node[at + shift])]
        found.append(np.column_stack([group[at], group[at + shift]]))
    return np.unique(np.concatenate(found), axis=0)


def _in_large(node: np.ndarray, group: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """As :func:`_in_small` for one large bucket; ``side`` asks for pairs between its two sides."""
    names, label = np.unique(group, return_inverse=True)
    now, found = label.copy(), []
    for i in range(len(node)):
        met = now != now[i]
        if side is not None:
            met &= side != side[i]
        met &= _close(node, node[i])
        joined = np.unique(now[met])
        if len(joined):
            # A pair of members that truly link stands for each of the components.
            for other in joined.tolist():
                j = np.flatnonzero(met & (now == other))[0]
                found.append((names[label[i]], names[label[j]]))
            now[np.isin(now, joined)] = now[i]
            if (now == now[0]).all():
                break
    return np.array(found, np.int64).reshape(-1, 2)


def _search(batches: Iterator[pa.RecordBatch], n_keys: int, blocks: bool) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows: ``n_keys`` columns of the bucket, then ``node`` and ``component``.

    With ``blocks`` the keys are a variant and the numbers of two blocks, and a column
    with the block of the row follows them; pairs between the two blocks are asked for.
    """

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        keys, node, group = columns[:n_keys], columns[-2], columns[-1]
        starts = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        edges = np.append(np.flatnonzero(starts), len(node))
        size = np.diff(edges)
        forest = Forest()
        small = np.repeat(size <= _SMALL, size)
        cross = keys[1] != keys[2] if blocks else np.zeros(len(node), bool)
        small &= ~cross
        forest.add(_in_small(starts[small], node[small], group[small]))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if not small[s] and group[s:e].min() != group[s:e].max():
                side = columns[n_keys][s:e] == keys[1][s] if cross[s] else None
                forest.add(_in_large(node[s:e], group[s:e], side))
        found = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:n_keys]], axis=0))
        last = int(changed[-1]) + 1 if len(changed) else 0
        if last:
            yield links([c[:last] for c in columns])
        held = [c[last:] for c in columns]
    if held is not None:
        yield links(held)


def _segments(node: str) -> list[str]:
    return [f"shiftrightunsigned({node}, {first}) & {(1 << width) - 1}" for first, width in SEGMENTS]


def _variants(value: str, segment: int) -> str:
    """Keys of a segment's variants: the wildcard's bit, then the other bits in their places."""
    first, width = SEGMENTS[segment]
    return (
        f"transform(sequence(0, {width - 1}), i ->"
        f" shiftleft(cast({first} + i AS bigint), 22) | ({value} & ~shiftleft(cast(1 AS bigint), i)))"
    )


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with components moved on along links between components."""
    moved = components(links).selectExpr("node AS component", "component AS further")
    return nodes.join(moved, "component", "left").selectExpr("node", "coalesce(further, component) AS component")


def _among_neighbours(nodes: DataFrame, crowded: DataFrame, block_rows: int) -> DataFrame:
    """Links between nodes near in order, of the values of a segment that many nodes share."""
    values = ", ".join(f"struct({s} AS segment, {v} AS value)" for s, v in enumerate(_segments("node")))
    members = nodes.selectExpr("node", "component", f"inline(array({values}))").join(
        crowded.select("segment", "value"), ["segment", "value"], "left_semi"
    )
    # By range, so that a value's nodes span tasks; runs of a value inside a task are blocks.
    dealt = (
        members.repartitionByRange("segment", "value", "node")
        .sortWithinPartitions("segment", "value", "node")
        .select("segment", "value", "node", "component")
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            run = (seen + np.arange(batch.num_rows)) // block_rows
            seen += batch.num_rows
            segment, value, node, component = batch.columns
            yield pa.RecordBatch.from_arrays(
                [segment, value, pa.array(run), node, component], ["segment", "value", "run", "node", "component"]
            )

    return dealt.mapInArrow(lambda batches: _search(runs(batches), 3, False), "a bigint, b bigint")


def _crowded_variants(nodes: DataFrame, crowded: DataFrame, block_rows: int) -> DataFrame:
    """``variant, k``: variants that may have more than ``block_rows`` members, and their blocks; 0 if closed.

    A variant's members are those of two values. Where only one of them is crowded, the
    other has at most half a block.
    """
    parts = ", ".join(
        f"CASE WHEN segment = {s} THEN {_variants('value', s)} ELSE array() END" for s in range(len(SEGMENTS))
    )
    sized = (
        crowded.selectExpr(f"explode(concat({parts})) AS variant", "n")
        .groupBy("variant")
        .agg(F.sum("n").alias("n"))
        .selectExpr("variant", f"cast(ceil((n + {block_rows // 2}) / {block_rows}) AS int) AS k")
    )
    sized = materialize(sized, "crowded-variants")
    state = (
        _indexed(nodes)
        .join(sized, "variant")
        .groupBy("variant")
        .agg(F.max("k").alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    )
    return materialize(state.selectExpr("variant", "if(lo = hi, 0, k) AS k"), "open-variants")


def _indexed(nodes: DataFrame) -> DataFrame:
    """``variant, node, component``: a row for each of a node's variants."""
    parts = ", ".join(_variants(v, s) for s, v in enumerate(f"({x})" for x in _segments("node")))
    return nodes.selectExpr(f"explode(concat({parts})) AS variant", "node", "component")


def linked(documents: DataFrame, shingle: int = 4, block_rows: int = 2048) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    prepared(documents.sparkSession)
    prints = materialize(fingerprints(documents, shingle), "fingerprints")
    names = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("first_doc")), "nodes")
    nodes = names.selectExpr("node", "node AS component")
    values = ", ".join(f"struct({s} AS segment, {v} AS value)" for s, v in enumerate(_segments("node")))
    crowded = materialize(
        nodes.selectExpr(f"inline(array({values}))")
        .groupBy("segment", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(f"n > {block_rows // 2}"),
        "crowded",
    )
    if crowded.isEmpty():
        indexed = _indexed(nodes).withColumn("k", F.lit(1))
    else:
        nodes = materialize(_joined(nodes, _among_neighbours(nodes, crowded, block_rows)), "joined")
        cut = _crowded_variants(nodes, crowded, block_rows)
        indexed = _indexed(nodes).join(cut, "variant", "left").withColumn("k", F.expr("coalesce(k, 1)"))
    dealt = (
        indexed.filter("k > 0")
        .withColumn("block", F.expr("cast(pmod(xxhash64(node), k) AS int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
        .selectExpr(
            "variant", "least(block, other) AS i", "greatest(block, other) AS j", "block", "node", "component"
        )
        .repartition("variant", "i", "j")
        .sortWithinPartitions("variant", "i", "j", "node")
    )
    found = materialize(
        dealt.mapInArrow(lambda batches: _search(batches, 3, True), "a bigint, b bigint").distinct(), "links"
    )
    named = materialize(_joined(nodes, found).join(names, "node"), "named")
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    classes = named.join(least, "component").select("node", "component_id")
    return prints.join(classes, "node").selectExpr(
        "doc_id", "lower(lpad(hex(node), 16, '0')) AS fingerprint", "coalesce(component_id, doc_id) AS component_id"
    )
