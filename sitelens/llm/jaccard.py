"""Jaccard join of word n-gram sets over an R-tree of count vectors.

A document's n-grams are hashed into groups; how many fall into each group is a point.
Two sets share at most the sum of the smaller coordinates, and a node of the tree, by
its largest coordinates, bounds all points below it. Pairs that pass the bound are
verified on the whole sets.

How points meet in a task: two sets of Jaccard similarity ``t`` share one of the
``n - ceil(t n) + 1`` n-grams that come first in any common order; here rare ones come
first, by counts of hash classes in a table of fixed size, then by hash. Points are dealt
by those n-grams, into buckets.

* Equal sets are one point from the start.
* First pass: each member of a bucket is tried against the bucket's first point, in
  crowded buckets also against one before it. Groups of near copies fall together
  here, in linear work.
* The same once more for buckets that still hold points of different components: each
  member is tried against one earlier member.
* Second pass: buckets that still hold points of different components are searched
  whole with the tree, pairs inside a component passed over; buckets with the same points
  are searched once. Large buckets are cut into blocks, and tasks take pairs of blocks.
  Of what the tree lets through, finer points leave what they cannot rule out (the tree's
  groups are too few for long texts), and equal buckets of these points are one again. Then
  whole sets verify it in the task, which passes on only links that join what was apart,
  fewer than its points.

The result is the component of every document, and components only: no link that joins
two components is lost, but pairs inside a component found so far are not verified, so
neither the pairs nor the number of links of a document can be had. No list of all pairs
in a group is ever made.

Defined cases. Words are split at ASCII blanks, A-Z in lower case. Fewer words than an
n-gram are one n-gram of their own length. A text without words, or null, has an empty
set: it links with nothing and is its own component, also where ids repeat. Rows
repeated under one id are one document if their sets are equal; else each is a set of
its own under that id. Documents without id take part; a component's id is its smallest
known one, null if there is none. An empty table gives no rows. Further columns are
ignored; the result has its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import prepared
from sitelens.session import materialize

#: Groups of n-gram hashes: the coordinates of a point. The tree puts them together to
#: ``_COARSE``; pairs that pass there are bounded by all, and at last by finer points, of
#: about two n-grams a group.
GROUPS = 256
_COARSE = 64
_FINEST = 4096
#: Classes of n-grams whose counts order the n-grams of a document.
_ORDER_CLASSES = 1 << 20
# Classes whose counts travel as one row.
_SLICE = 1 << 12
# From this place in a bucket on, a member tries one before it too.
_CROWD = 8
_LEAF = 32
# N-grams of a block's sets, pairs a task remembers as verified in vain, and words it knows.
_BLOCK_NGRAMS = 1_000_000
_REMEMBERED = 1_000_000
_KNOWN = 200_000
_POINT = "doc_id bigint, text_id bigint, node bigint, n int, counts binary, fine binary, prefix array<bigint>"
#: Node numbers that are looked up by broadcast; above, by shuffle.
_MAX_BROADCAST = 1_000_000


class Shingles:
    """Sorted distinct n-gram hashes of texts; word hashes are remembered."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self.known) > _KNOWN:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.n, len(words))
        mixed = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            mixed = (mixed ^ hashes[i : len(words) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view(np.int64))


def group_counts(shingles: np.ndarray, groups: int = GROUPS) -> bytes:
    """A point as a shift and a byte per coordinate, shifted by it and rounded up.

    Rounded up, coordinates still bound the overlap from above; below 256 they are exact.
    """
    # Low bits make the groups, high bits the order: the two owe each other nothing.
    counts = np.bincount(shingles & (groups - 1), minlength=groups)
    shift = 0
    while -(-int(counts.max()) >> shift) > 255:
        shift += 1
    return bytes([shift]) + (-(-counts >> shift)).astype(np.uint8).tobytes()


def _coordinates(points: pa.Array | pa.ChunkedArray) -> np.ndarray:
    packed = np.frombuffer(b"".join(points.to_pylist()), np.uint8).reshape(-1, GROUPS + 1).astype(np.int32)
    return packed[:, 1:] << packed[:, :1]


def _fine_groups(n: int) -> int:
    """A power of two near half the set's size."""
    return min(_FINEST, max(GROUPS, 1 << (n // 2).bit_length()))


def shared_at_most(one: bytes, two: bytes) -> int:
    """Summed coordinate minima of two packed points; groups of the finer one are put together."""
    p, q = (np.frombuffer(x, np.uint8, offset=1).astype(np.int64) << x[0] for x in (one, two))
    if len(p) != len(q):
        size = min(len(p), len(q))
        p, q = (x.reshape(-1, size).sum(axis=0) for x in (p, q))
    return int(np.minimum(p, q).sum())


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _order_class(shingles: np.ndarray) -> np.ndarray:
    """Which of the counted classes a hash is in, by bits that neither groups nor ties use."""
    return (shingles >> 20) & (_ORDER_CLASSES - 1)


def _class_counts(n: int):
    """How many n-grams of a task's texts fall into each class, a slice of the classes to a row.

    Counts are packed byte by byte of their value, lowest first, so that the many zeros lie together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingles(n), np.zeros(_ORDER_CLASSES, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                # A set's classes repeat at times.
                np.add.at(counts, _order_class(shingles(text)), 1)
        slices = counts.reshape(-1, _SLICE)
        held = np.flatnonzero(slices.any(axis=1))
        for at in held.tolist():
            packed = slices[at].view(np.uint8).reshape(_SLICE, 8).T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed])], ["slice", "counts"])

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices' counts as levels: two for each doubling, a byte a class."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(*(c.to_pylist() for c in batch.columns)):
            counts = np.frombuffer(packed, np.uint8).reshape(8, _SLICE).T.copy().view(np.int64)[:, 0]
            sums[at] = sums[at] + counts if at in sums else counts
    for at, counts in sums.items():
        levels = (2 * np.log2(np.maximum(counts, 1))).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([levels])], ["slice", "levels"])


def order_levels(texts: DataFrame, n: int) -> np.ndarray:
    """A level per class of n-grams, rising with the number of documents that hold them.

    The table has a fixed size, whatever the corpus. It decides only which n-grams come
    first in the common order, not which documents link: rare ones come first, so that
    a passage of many documents is in few prefixes.
    """
    counted = texts.select("text").mapInArrow(_class_counts(n), "slice int, counts binary")
    levels = np.zeros((_ORDER_CLASSES // _SLICE, _SLICE), np.uint8)
    for row in counted.repartition("slice").mapInArrow(_levels, "slice int, levels binary").collect():
        levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.reshape(-1)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """A list per array, without a Python number for each value."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _points(n: int, percent: int, levels: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            rows = []
            for doc_id, text_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingles(text)
                if not len(found):
                    rows.append((doc_id, text_id, None, 0, None, None, None))
                    continue
                node = xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)
                # By level, then by hash: the same order for every document.
                ranked = np.argsort(levels.value[_order_class(found)], kind="stable")
                prefix = found[ranked[: _prefix_length(len(found), percent)]].tolist()
                fine = group_counts(found, _fine_groups(len(found)))
                rows.append((doc_id, text_id, node, len(found), group_counts(found), fine, prefix))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in _POINT.split(", ")]
            )

    return run


def _alike(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sizes allow the similarity."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _leaders(percent: int):
    """Rows of buckets with company, each with the points to try first if sizes allow a link.

    ``leader`` is the bucket's first point. In a group in which many pairs link, but few
    with the first, ``before`` leads on: an earlier member of the bucket, another one in
    each bucket, as a hash of member and bucket has it.
    """

    def emit(shingle, node, n, leader, leader_n, shared, place) -> pa.RecordBatch:
        ok = shared & (leader != node) & _alike(n, leader_n, percent)
        mixed = (shingle ^ (node >> 7)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        back = 1 + (mixed >> np.uint64(40)).astype(np.int64) % np.maximum(place, 1)
        at = np.maximum(np.arange(len(node)) - back, 0)
        tried = (place >= _CROWD) & _alike(n, n[at], percent)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(shingle[shared]),
                pa.array(node[shared]),
                pa.array(leader[shared], mask=~ok[shared]),
                pa.array(node[at][shared], mask=~tried[shared]),
            ],
            ["shingle", "node", "leader", "before"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row read: whether it has company shows in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, node, n = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                shingle, node, n = (np.concatenate([[h], c]) for h, c in zip(held[:3], (shingle, node, n)))
            new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            leader, leader_n, company = node[first], n[first], ~new
            place = np.arange(len(new)) - first
            if held is not None:
                same = first == 0
                leader, leader_n = np.where(same, held[3], leader), np.where(same, held[4], leader_n)
                company[0] = held[5]
            company[:-1] |= ~new[1:]
            held = (shingle[-1], node[-1], n[-1], leader[-1], leader_n[-1], company[-1])
            cut = slice(0, len(new) - 1)
            yield emit(*(x[cut] for x in (shingle, node, n, leader, leader_n, company, place)))
        if held is not None:
            yield emit(*(np.array([x]) for x in (*held, 0)))

    return run


def _partners(percent: int):
    """Pairs of members of different components: each member with an earlier one of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, node, n, group = (batch.column(i).to_numpy() for i in range(4))
            new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
            place = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            mixed = (shingle ^ (node >> 5)).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            at = np.maximum(np.arange(len(new)) - 1 - (mixed >> np.uint64(40)).astype(np.int64) % np.maximum(place, 1), 0)
            ok = (place > 0) & (group != group[at]) & _alike(n, n[at], percent)
            found = np.unique(np.column_stack([np.minimum(node, node[at]), np.maximum(node, node[at])])[ok], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


class CountTree:
    """A binary R-tree: each node lies under the largest coordinates of its points.

    Bulk-loaded from the top, by halves on the coordinate that spreads most, so all leaves
    lie at one depth and the children of node ``i`` are ``2 i`` and ``2 i + 1``.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        order, cuts, spread = np.arange(len(sizes)), [0, len(sizes)], np.column_stack([counts, sizes])
        while (cuts[1] - cuts[0]) > _LEAF:
            halves = [0]
            for s, e in zip(cuts, cuts[1:]):
                points, half = spread[order[s:e]], (e - s) // 2
                widest = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
                order[s:e] = order[s:e][np.argpartition(points[:, widest], half)]
                halves += [s + half, e]
            cuts = halves
        self.order, self.counts, self.sizes, self.groups = order, counts[order], sizes[order], groups[order]
        self.cuts = cuts
        tops = [(self.counts, np.maximum), (self.sizes, np.minimum), (self.sizes, np.maximum),
                (self.groups, np.minimum), (self.groups, np.maximum)]
        level = [f.reduceat(x, cuts[:-1], axis=0) for x, f in tops]
        #: From the root down: corner, least and most size, lowest and highest group of each node.
        self.levels = [level]
        while len(level[1]) > 1:
            level = [f(x[::2], x[1::2]) for x, (_, f) in zip(level, tops)]
            self.levels.insert(0, level)

    def _open(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether points below both nodes may link: none shares more than the corners allow."""
        corner, least, most, low, high = self.levels[level]
        room = np.minimum(corner[a], corner[b]).sum(axis=1)
        open_ = (100 + percent) * room >= percent * (least[a] + least[b])
        open_ &= 100 * np.minimum(most[a], most[b]) >= percent * np.maximum(least[a], least[b])
        return open_ & ~((low[a] == high[b]) & (high[a] == low[b]))

    def pairs(self, percent: int, cross: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of different groups that the bounds cannot rule out.

        ``cross``, one flag per point, asks for pairs between the two flags only.
        """
        flags = cross[self.order] if cross is not None else None
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels)):
            if level:
                same, a, b = a == b, 2 * a, 2 * b
                a, b = np.concatenate([a, a, a + 1, (a + 1)[~same]]), np.concatenate([b, b + 1, b + 1, b[~same]])
            kept = self._open(level, a, b, percent)
            a, b = a[kept], b[kept]
        for i, j in zip(a.tolist(), b.tolist()):
            p, q = slice(self.cuts[i], self.cuts[i + 1]), slice(self.cuts[j], self.cuts[j + 1])
            n, m = self.sizes[p, None], self.sizes[None, q]
            shared = np.minimum(self.counts[p, None], self.counts[None, q]).sum(axis=2, dtype=np.int64)
            ok = ((100 + percent) * shared >= percent * (n + m)) & _alike(n, m, percent)
            ok &= self.groups[p, None] != self.groups[None, q]
            if i == j:
                ok &= np.arange(ok.shape[0])[:, None] < np.arange(ok.shape[1])[None]
            if flags is not None:
                ok &= flags[p, None] != flags[None, q]
            left, right = np.nonzero(ok)
            if len(left):
                yield self.order[p][left], self.order[q][right]


class Merged:
    """Components that a task has put together so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (above := self.parent.get(top, top)) != top:
            top = above
        while x != top:
            self.parent[x], x = top, self.parent[x]
        return top

    def join(self, x: int, y: int) -> None:
        self.parent[self.find(x)] = self.find(y)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole buckets, with their bounds; rows come sorted by bucket and pair of blocks."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = np.column_stack([table.column(i).to_numpy() for i in range(3)])
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        last = int(ends[-1]) if len(ends) else 0
        if last:
            yield table.slice(0, last), [0, *ends.tolist()]
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest, [0, rest.num_rows]


def _passed(
    table: pa.Table, bounds: list[int], group: np.ndarray, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of pairs of different groups that the tree and then all coordinates let through."""
    i_block, j_block, block = (table.column(k).to_numpy() for k in (1, 2, 3))
    n, counts = table.column(5).to_numpy().astype(np.int64), _coordinates(table.column(7))
    coarse = counts.reshape(-1, GROUPS // _COARSE, _COARSE).sum(axis=1)
    for s, e in zip(bounds, bounds[1:]):
        if e - s < 2 or group[s:e].min() == group[s:e].max():
            continue
        cross = block[s:e] == i_block[s] if i_block[s] != j_block[s] else None
        for p, q in CountTree(coarse[s:e], n[s:e], group[s:e]).pairs(percent, cross):
            p, q = p + s, q + s
            room = np.minimum(counts[p], counts[q]).sum(axis=1)
            ok = (100 + percent) * room >= percent * (n[p] + n[q])
            yield p[ok], q[ok]


def _candidates(percent: int, finer: bool = False):
    """Rows whose point has a partner in its pair of blocks that the bounds let through.

    ``finer`` bounds by the finer points too, which then are the last column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _buckets(batches):
            wanted = np.zeros(table.num_rows, bool)
            n, fine = table.column(5).to_numpy(), table.column(8).to_pylist() if finer else None
            for p, q in _passed(table, bounds, table.column(6).to_numpy(), percent):
                if not finer:
                    wanted[p] = wanted[q] = True
                    continue
                open_ = ~(wanted[p] & wanted[q])
                for x, y in zip(p[open_].tolist(), q[open_].tolist()):
                    if not (wanted[x] and wanted[y]):
                        room = shared_at_most(fine[x], fine[y])
                        if (100 + percent) * room >= percent * (int(n[x]) + int(n[y])):
                            wanted[x] = wanted[y] = True
            yield from table.select(range(5)).filter(pa.array(wanted)).to_batches()

    return run


def _joined(percent: int):
    """Links that join components, verified on the whole sets.

    What a link joins is one component from then on: a task gives fewer links than it
    holds components, however many pairs pass the bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged, unlike = Merged(), set()
        for table, bounds in _buckets(batches):
            node, n, component = (table.column(k).to_numpy() for k in (4, 5, 6))
            members = table.column(8).combine_chunks()
            at, members = members.offsets.to_numpy(), members.values.to_numpy()
            group = np.array([merged.find(c) for c in component.tolist()], np.int64)
            links = []
            for p, q in _passed(table, bounds, group, percent):
                for x, y in zip(p.tolist(), q.tolist()):
                    one, two = merged.find(int(component[x])), merged.find(int(component[y]))
                    pair = (int(min(node[x], node[y])), int(max(node[x], node[y])))
                    if one == two or pair in unlike:
                        continue
                    shared = len(np.intersect1d(members[at[x] : at[x + 1]], members[at[y] : at[y + 1]], assume_unique=True))
                    if (100 + percent) * shared >= percent * (int(n[x]) + int(n[y])):
                        merged.join(one, two)
                        links.append(pair)
                    elif len(unlike) < _REMEMBERED:
                        unlike.add(pair)
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """``node, component``: smallest node reachable over ``a, b`` links, by alternating stars.

    Links shrink to stars around the smallest node; each round is a written table.
    """
    edges = materialize(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(least, "u").filter("v > u").selectExpr("v AS u", "m AS v")
        large = materialize(large.filter("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("inline(array(struct(u, m AS v), struct(v AS u, m AS v)))")
        edges = materialize(small.filter("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.selectExpr("u AS node", "v AS component")
        state = now


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found)], ["node", "members"])

    return run


def sets_of(nodes: DataFrame, texts: DataFrame, owners: DataFrame, n: int) -> DataFrame:
    """``node, members``: the whole set of each of the nodes, in order, from their texts."""
    wanted = materialize(nodes.join(owners, "node"), "pair-nodes")
    few = wanted.limit(_MAX_BROADCAST + 1).count() <= _MAX_BROADCAST
    chosen = (
        texts.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), "text")
        .join(
            F.broadcast(wanted) if few else wanted,
            (F.col("_text") == F.col("text_id")) & F.col("_doc").eqNullSafe(F.col("doc_id")),
        )
        .select("node", "text")
    )
    return materialize(
        chosen.mapInArrow(_sets(n), "node bigint, members array<bigint>").dropDuplicates(["node"]), "pair-sets"
    )


def verified(pairs: DataFrame, texts: DataFrame, owners: DataFrame, n: int, percent: int) -> DataFrame:
    """The ``a, b`` pairs whose whole sets are similar enough.

    ``owners`` has per ``node`` the ``text_id`` and ``doc_id`` of one of its documents.
    """
    nodes = pairs.selectExpr("inline(array(struct(a AS node), struct(b AS node)))").distinct()
    sets = sets_of(nodes, texts, owners, n)
    left = sets.selectExpr("node AS a", "members AS mine")
    right = sets.selectExpr("node AS b", "members AS theirs")
    common = "size(array_intersect(mine, theirs))"
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .filter(f"100 * {common} >= {percent} * (size(mine) + size(theirs) - {common})")
        .select("a", "b")
    )


def linked(documents: DataFrame, n: int = 4, percent: int = 85, block_rows: int = 2000) -> DataFrame:
    """``doc_id, text_id, n_shingles, component_id`` of every document."""
    prepared(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    levels = documents.sparkSession.sparkContext.broadcast(order_levels(texts, n))
    points = materialize(
        texts.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
        .mapInArrow(_points(n, percent, levels), _POINT)
        .withColumn("row", F.monotonically_increasing_id()),
        "points",
    )
    slim = points.select("doc_id", "text_id", "node", "n", "row")
    # Equal sets are one node; one of its rows stands for it.
    owners = materialize(
        slim.filter("node IS NOT NULL").groupBy("node").agg(
            F.min(F.struct("row", "text_id", "doc_id", "n")).alias("o"), F.min("doc_id").alias("first_doc")
        ).select("node", "o.row", "o.text_id", "o.doc_id", "o.n", "first_doc"),
        "nodes",
    )
    own = points.join(owners.select("row"), "row", "left_semi")
    shared = materialize(
        own.select(F.explode("prefix").alias("shingle"), "node", "n")
        .repartition("shingle")
        .sortWithinPartitions("shingle", "node")
        .mapInArrow(_leaders(percent), "shingle bigint, node bigint, leader bigint, before bigint"),
        "buckets",
    )
    met = owners.select("node", "row").join(shared.select("node").distinct(), "node", "left_semi")
    vectors = materialize(
        points.select("node", "n", "counts", "fine", "row").join(met.select("row"), "row", "left_semi").drop("row"), "vectors"
    )
    ids = owners.select("node", "text_id", "doc_id")
    tried = shared.selectExpr(
        "node", "explode(array_compact(array(leader, before))) AS other"
    ).selectExpr("least(node, other) AS a", "greatest(node, other) AS b").distinct()
    near = _bounded(_bounded(tried, vectors, "counts", percent), vectors, "fine", percent)
    first = materialize(verified(near, texts, ids, n, percent), "first-links")
    grouped, open_rows = _open_buckets(shared, vectors, first, block_rows)
    partners = (
        open_rows.join(grouped.select("node", "n", "component").hint("merge"), "node")
        .select("shingle", "node", "n", "component")
        .repartition("shingle")
        .sortWithinPartitions("shingle", "node")
        .mapInArrow(_partners(percent), "a bigint, b bigint")
        .distinct()
    )
    near = _bounded(_bounded(partners, vectors, "counts", percent), vectors, "fine", percent)
    first = materialize(first.unionByName(verified(near, texts, ids, n, percent)), "more-links")
    grouped, open_rows = _open_buckets(shared, vectors, first, block_rows)
    # A bucket of k blocks goes to k (k + 1) / 2 tasks, two blocks to each.
    dealt = (
        open_rows.withColumn("block", F.expr("cast(pmod(xxhash64(node, 1), k) AS int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
        .selectExpr("shingle", "least(block, other) AS i", "greatest(block, other) AS j", "block", "node")
    )
    # Sets travel only with points that have a partner within the bounds.
    near = materialize(
        _by_blocks(dealt, grouped).mapInArrow(
            _candidates(percent), "shingle bigint, i int, j int, block int, node bigint"
        ),
        "candidates",
    )
    finer = grouped.join(vectors.select("node", "fine"), "node")
    near = materialize(
        _by_blocks(near, finer, "fine").mapInArrow(
            _candidates(percent, finer=True), "shingle bigint, i int, j int, block int, node bigint"
        ),
        "finer-candidates",
    )
    near = _different(near)
    sets = sets_of(near.select("node").distinct(), texts, ids, n)
    rest = materialize(
        _by_blocks(near, grouped.join(sets, "node"), "members").mapInArrow(_joined(percent), "a bigint, b bigint"),
        "second-links",
    )
    links = first.unionByName(rest)
    final = owners.select("node", "first_doc").join(components(links), "node", "left").selectExpr(
        "node", "first_doc", "coalesce(component, node) AS component"
    )
    names = final.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = final.join(names, "component").select("node", "component_id")
    return slim.join(named, "node", "left").select(
        "doc_id",
        "text_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def _by_blocks(rows: DataFrame, points: DataFrame, *further: str) -> DataFrame:
    """Rows of buckets with their points, a pair of blocks together."""
    return (
        rows.join(points.hint("merge"), "node")
        .select("shingle", "i", "j", "block", "node", "n", "component", "counts", *further)
        .repartition("shingle", "i", "j")
        .sortWithinPartitions("shingle", "i", "j", "node")
    )


def _different(rows: DataFrame) -> DataFrame:
    """Rows of one of each kind of pairs of blocks that hold the same points on the same sides."""
    side = "CASE WHEN i = j THEN 0 WHEN block = i THEN 1 ELSE 2 END"
    kinds = rows.selectExpr("*", f"{side} AS side").groupBy("shingle", "i", "j").agg(
        F.count(F.lit(1)).alias("m"),
        F.expr("bit_xor(xxhash64(node, side))").alias("mixed"),
        F.expr("bit_xor(xxhash64(side, node, 1))").alias("mixed_again"),
    )
    one = kinds.groupBy("m", "mixed", "mixed_again").agg(F.min(F.struct("shingle", "i", "j")).alias("one"))
    return materialize(rows.join(one.select("one.*"), ["shingle", "i", "j"], "left_semi"), "different-candidates")


def _open_buckets(
    shared: DataFrame, vectors: DataFrame, links: DataFrame, block_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Points with their component so far, and the ``shingle, node, k`` rows of buckets that hold several.

    ``k`` is the number of blocks that the bucket is cut into, by points and by n-grams of
    their sets. Buckets with the same points (a passage has many n-grams) are one: the
    points' number, size and two hashes of all points tell.
    """
    grouped = materialize(
        vectors.join(components(links), "node", "left").selectExpr(
            "node", "n", "counts", "coalesce(component, node) AS component"
        ),
        "grouped",
    )
    rows = shared.select("shingle", "node").join(grouped.select("node", "n", "component"), "node")
    several = (
        rows.groupBy("shingle")
        .agg(
            F.count(F.lit(1)).alias("m"),
            F.sum("n").alias("ngrams"),
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            F.expr("bit_xor(node)").alias("mixed"),
            F.expr("bit_xor(xxhash64(node))").alias("mixed_again"),
        )
        .filter("lo <> hi")
        .groupBy("m", "ngrams", "lo", "hi", "mixed", "mixed_again")
        .agg(F.min("shingle").alias("shingle"))
        .selectExpr(
            "shingle", f"cast(greatest(ceil(m / {block_rows}), ceil(ngrams / {_BLOCK_NGRAMS})) AS int) AS k"
        )
    )
    found = rows.join(several.hint("merge"), "shingle").select("shingle", "node", "k")
    return grouped, materialize(found, "open-buckets")


def _bounded(pairs: DataFrame, vectors: DataFrame, point: str, percent: int) -> DataFrame:
    """Pairs whose summed coordinate minima allow the similarity; ``point`` names the coordinates."""
    one = vectors.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(point).alias("c_a"))
    two = vectors.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(point).alias("c_b"))
    columns = ["a", "b", "n_a", "n_b", "c_a", "c_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
            room = np.array(
                [shared_at_most(p, q) for p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64
            )
            ok = (100 + percent) * room >= percent * (n.astype(np.int64) + m)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    joined = pairs.join(two, "b").join(one, "a").select(*columns)
    return materialize(joined.mapInArrow(run, "a bigint, b bigint"), "bounded-pairs")
