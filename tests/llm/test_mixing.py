"""Source targets, block permutations and what a mix takes."""

import pytest
from pyspark.sql import functions as F

from sitelens.llm import mixing


@pytest.mark.parametrize(
    "sizes, want",
    [
        ([100, 100, 100], [50, 100, 150]),
        ([10, 100, 1000], [30, 300, 780]),
        ([1000, 1, 1], [1002 - 6, 3, 3]),
        ([0, 10], [0, 10]),
        ([0, 0], [0, 0]),
        ([], []),
    ],
)
def test_targets(sizes, want):
    assert mixing.source_targets(list(enumerate(sizes))) == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 100, 1001])
def test_permutations(spark, n):
    df = spark.range(n).select(F.expr("id AS i"), F.lit(n).alias("n"))
    passes = [[r.p for r in df.select("i", mixing.permuted("i", "n", f"7, {t}").alias("p")).orderBy("i").collect()] for t in (0, 1)]
    assert all(sorted(p) == list(range(n)) for p in passes)
    assert n < 100 or passes[0] != passes[1]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_mix(documents):
    docs = [(i, " ".join(["w"] * (1 + i * 37 % 300)), None, f"s{i % 4}" if i % 7 else None) for i in range(400)]
    docs += [(900, None, None, "s0"), (901, " \n", None, "s0"), (902, "a b", None, "s0"), (902, "a b", None, "s0")]
    df = documents(docs)
    first, again = rows(mixing.mix(df)), rows(mixing.mix(df.repartition(3)))
    assert first == again and len(first) == len(docs)
    by_source = {}
    for doc, size, source_size, target, taken in first:
        assert 0 <= taken <= 3 * size
        by_source.setdefault((source_size, target), []).append(taken)
    assert sum(t for _, t in by_source) == pytest.approx(sum(r[1] for r in first))
    for (_, target), taken in by_source.items():
        assert sum(taken) == pytest.approx(target, rel=0.05)


def test_empty_tables(documents, odd):
    assert rows(mixing.mix(documents([]))) == []
    assert rows(mixing.mix(documents([(1, None), (2, "")]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert len(rows(mixing.mix(documents(odd)))) == len(odd)


def test_shards_hold_the_texts(documents):
    docs = [(i, " ".join(f"d{i}w{j}" for j in range(1 + i * 37 % 90)), None, f"s{i % 3}" if i % 7 else None) for i in range(120)]
    made = mixing.planned(documents([*docs, (900, None, None, "s0")]), block=16, shard_slots=64)
    taken = {r.doc_id: r.taken for r in made.taken().collect()}
    shards = made.shards().collect()
    text, source = {d: t.split() for d, t, _, _ in docs}, {d: s for d, _, _, s in docs}
    places = sorted((r.shard, r.slot) for r in shards)
    assert len(set(places)) == len(places) and max(s for _, s in places) < 64
    counts, blocks = dict.fromkeys(taken, 0), {}
    for r in shards:
        assert 0 < len(r.tokens) <= 16 and 0 <= r["pass"] < 3
        assert blocks.setdefault((r.source, r.block), r.tokens) == r.tokens
        before = None
        for token in r.tokens:
            doc, at = map(int, token[1:].split("w"))
            assert text[doc][at] == token and source[doc] == r.source
            # Tokens follow each other in their document, and the next document starts anew.
            assert before is None or at == (before[1] + 1 if before[0] == doc else 0)
            before, counts[doc] = (doc, at), counts[doc] + 1
    assert counts == taken
