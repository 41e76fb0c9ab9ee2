"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from sitelens.llm import jaccard


def expected(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        size = min(n, len(w))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(doc, ids.get(find(i), doc))
    return sorted(
        ((doc, len(sets[i]), ids.get(find(i), doc) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr
    )


def found(df, **settings):
    rows = jaccard.linked(df, **settings).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def mutated(rng, words, share):
    return " ".join(w if rng.random() > share else f"m{rng.randint(0, 10**6)}" for w in words)


def test_near_copies_and_shared_passages(documents):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for g in range(12):
        base = [f"b{g}x{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))]
        rows += [(len(rows) + i, mutated(rng, base, rng.choice([0, 0.005, 0.02, 0.05]))) for i in range(12)]
    rows += [(1000 + i, " ".join([f"own{i}w{j}" for j in range(rng.randint(1, 60))] + passage)) for i in range(60)]
    # A chain: each links with the next, the ends do not.
    chain = [f"c{i}" for i in range(200)]
    rows += [(2000 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(20)]
    rng.shuffle(rows)
    df = documents(rows)
    assert found(df) == expected(rows)
    assert found(df, n=5, percent=80, block_rows=8) == expected(rows, 5, 80)


def test_odd_rows(documents, odd):
    rows = odd + [(9, "ONE"), (10, "one two three"), (11, "two three"), (None, "no id here")]
    assert found(documents(rows)) == expected(rows)
    assert found(documents([])) == []


@pytest.mark.parametrize("seed", range(3))
def test_bounds_never_rule_out_a_link(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 900)
    points = [np.unique(np.concatenate([base[:k], rng.integers(0, 1 << 60, m)])) for k, m in rng.integers(0, 900, (70, 2))]
    points += [np.unique(rng.integers(0, 1 << 60, 40_000))]
    packed = jaccard.pa.array([jaccard.group_counts(p) for p in points])
    counts = jaccard._coordinates(packed)
    for p, c in zip(points, counts):
        assert (c >= np.bincount(p & 255, minlength=256)).all()
    tree = jaccard.CountTree(counts, np.array([len(p) for p in points]), np.arange(len(points)))
    passed = {tuple(sorted((int(i), int(j)))) for a, b in tree.pairs(85) for i, j in zip(a, b)}
    for i in range(len(points)):
        for j in range(i):
            both = len(np.intersect1d(points[i], points[j]))
            if 100 * both >= 85 * (len(points[i]) + len(points[j]) - both):
                assert (j, i) in passed


def test_links_of_the_search_stay_below_the_points(documents, monkeypatch):
    """A crowd just below the similarity, and unlike texts around one passage."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, mutated(rng, base, rng.choice([0.015, 0.02, 0.025]))) for i in range(400)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, " ".join(f"own{i}w{j}" for j in range(20)) + " " + passage) for i in range(300)]
    counted, write = {}, jaccard.materialize

    def watched(df, name):
        out = write(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", watched)
    df = documents(rows)
    assert found(df, block_rows=64) == expected(rows)
    assert counted["second-links"] < len(rows)
    # The passage's n-grams lead to the same points: one bucket of the search, if any.
    assert counted["open-buckets"] < 20 * len(rows)


def test_order_levels_rise_with_counts(documents):
    df = documents([(i, "a b c d " + " ".join(f"x{i}y{j}" for j in range(8))) for i in range(200)])
    levels = jaccard.order_levels(df, 4)
    common, rare = (jaccard._order_class(jaccard.Shingles(4)(t)) for t in ("a b c d", "x1y0 x1y1 x1y2 x1y3"))
    assert levels[common[0]] == 15 and levels[rare[0]] < 3
    assert not jaccard.order_levels(documents([]), 4).any()


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 50), (200, 201), (201, 202), (7, 3)]
    df = spark.createDataFrame(links, "a BIGINT, b BIGINT")
    got = {r.node: r.component for r in jaccard.components(df).collect()}
    assert got == {**{i: 0 for i in [*range(1, 51), 100]}, 201: 200, 202: 200}


def test_long_unlike_texts_do_not_travel_whole(documents, monkeypatch):
    """Each two share a chunk; 256 groups are too few to tell texts of 20,000 words apart."""
    chunks = {(i, j): " ".join(f"c{i}x{j}w{k}" for k in range(2500)) for j in range(9) for i in range(j)}
    rows = [(d, " ".join(text for pair, text in chunks.items() if d in pair)) for d in range(9)]
    rows.append((20, rows[3][1] + " end"))
    counted, write = [], jaccard.materialize

    def watched(df, name):
        out = write(df, name)
        counted.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialize", watched)
    got = found(documents(rows))
    assert got == sorted(((d, len(t.split()) - 3, 3 if d == 20 else d) for d, t in rows), key=repr)
    assert [n for name, n in counted if name == "pair-sets"][-1] == 0


def test_equal_candidates_are_verified_once(spark):
    rows = [(s, 0, 0, 0, node) for s in (1, 2, 3) for node in (10, 11)] + [(4, 0, 0, 0, node) for node in (10, 11, 12)]
    # The same points, but dealt to blocks otherwise: other pairs meet.
    rows += [(5, 0, 1, 0, 10), (5, 0, 1, 1, 11), (6, 0, 1, 0, 10), (6, 0, 1, 0, 11), (6, 0, 1, 1, 12)]
    df = spark.createDataFrame(rows, "shingle bigint, i int, j int, block int, node bigint")
    assert sorted({r.shingle for r in jaccard._different(df).collect()}) == [1, 4, 5, 6]


def test_counts_of_classes_travel_packed(spark, documents):
    """However many classes the texts hold, their counts are a few rows a task."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(3000))) for i in range(20)]
    counted = documents(rows).select("text").coalesce(1).mapInArrow(jaccard._class_counts(4), "slice int, counts binary")
    assert counted.count() <= jaccard._ORDER_CLASSES // jaccard._SLICE
    sums = counted.mapInArrow(jaccard._levels, "slice int, levels binary").collect()
    assert sum(len(r.levels) for r in sums) == jaccard._ORDER_CLASSES
