"""Importance resampling against a plain recount, and its intern table."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from sitelens.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_force(docs, target, longest, buckets, seed, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in features(text, longest)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, longest)[1]:
            t[bucket(f)] += 1
    gain = [
        math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)
    ]
    rows = []
    for doc_id, text in docs:
        n, found = features(text, longest)
        weight = math.floor(sum(gain[bucket(f)] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, len(found), weight, score, None, n])
    ranked = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(ranked[: percent * len(ranked) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {f.dataType.simpleString() for f in df.schema} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 35), (2, 100)])
def test_equals_brute_force(spark, documents, odd, longest, percent):
    docs = odd + [
        (100 + i, " ".join(f"word{(i * k) % 41} Über7 the{'X' * (k % 3)}" for k in range(1 + i % 23))) for i in range(300)
    ]
    target = ["the word1 word2 über7 word1", "WORD3 the the", None, ""]
    wanted = spark.createDataFrame([(1, t, "clash") for t in target], "item_id BIGINT, text STRING, score STRING")
    got = resampling.resampled(documents(docs), wanted, longest, 97, 2024, 3, percent)
    assert rows(got) == brute_force(docs, target, longest, 97, 2024, 3, percent)


def test_ties_go_to_the_smaller_id_and_repeats_count(spark, documents):
    docs = [(5, "a b c")] * 4 + [(None, "a b c")] * 2 + [(i, "a b c") for i in range(20)]
    wanted = spark.createDataFrame([], "item_id BIGINT, text STRING")
    got = resampling.resampled(documents(docs), wanted, 1, 100, 2024, 1, 50)
    assert rows(got) == brute_force(docs, [], 1, 100, 2024, 1, 50)


def test_empty(spark, documents):
    wanted = spark.createDataFrame([(1, "x")], "item_id BIGINT, text STRING")
    assert resampling.resampled(documents([]), wanted).count() == 0


def test_equal_hashes_are_told_apart_by_their_bytes():
    """With a hash of few values every probe meets other n-grams of the same hash."""
    long = b"x" * 200
    text = b" ".join([b"a", b"b", b"ab", b"ba", b"a", long, long + b"y", long, b"b" * 33, b"b" * 33] * 5)
    grams = resampling.Grams([text, None, b"a b"], 2)
    table = resampling.Interned(grams, 1000, hashing=lambda gram: len(gram) % 3)
    data = grams.data.tobytes()
    names = [data[s:e] for s, e in zip(grams.start.tolist(), grams.end.tolist())]
    by_slot = {}
    for name, slot in zip(names, table.slots.tolist()):
        assert by_slot.setdefault(slot, name) == name
    assert len(by_slot) == len(set(names))
    for slot, name in by_slot.items():
        assert table.bucket[slot] == zlib.crc32(name) % 1000
        assert table.count[slot] == names.count(name)
    assert grams.n_features.tolist() == [50 + 49, 0, 3] and np.sum(table.count) == 102
