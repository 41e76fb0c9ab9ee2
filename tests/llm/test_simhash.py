"""SimHash classes against a comparison of all pairs."""

import random

import pyarrow as pa
import pytest
import xxhash

from sitelens.llm import simhash


def plain_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest id reachable for each ``(id, fingerprint)`` row."""
    names = sorted(set(f for _, f in prints))
    up = {f: f for f in names}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 4:
                up[top(a)] = top(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[top(f)] = min(d, least.get(top(f), d))
    return sorted(((d, f"{f:016x}", least.get(top(f))) for d, f in prints), key=repr)


def test_fingerprints_and_classes_of_texts(spark, documents, odd):
    rnd = random.Random(7)
    vocabulary = [f"wörd{i}" for i in range(500)]
    base = [" ".join(rnd.choices(vocabulary, k=120)) for _ in range(12)]
    docs = list(odd)
    for i in range(150):
        words = base[i % 12].split()
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary).upper()
        docs.append((1000 - i, "\t".join(words)))
    got = simhash.linked(documents(docs))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = classes([(d, plain_fingerprint(t)) for d, t in docs])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert 1 < len({c for _, _, c in want}) < len(docs) - 20


def near(rnd, center, bits):
    for b in rnd.sample(range(64), bits):
        center ^= 1 << b
    return center


@pytest.mark.parametrize("block_rows", [8, 64, 2048])
def test_links_at_any_place_of_the_bits(spark, documents, monkeypatch, block_rows):
    """Groups around centres, links of exactly four and five bits, crowded values, many blocks."""
    rnd = random.Random(block_rows)
    prints = [0, 1, (1 << 64) - 1, (1 << 64) - 16, (1 << 63)]
    for _ in range(150):
        one = rnd.getrandbits(64)
        prints += [one, near(rnd, one, rnd.choice((4, 5)))]
    for _ in range(3):
        center = rnd.getrandbits(64)
        prints += [near(rnd, center, rnd.randrange(6)) for _ in range(150)]
    shared = rnd.getrandbits(22)
    prints += [rnd.getrandbits(42) << 22 | shared for _ in range(120)]
    docs = [(i, str(f)) for i, f in enumerate(prints)]

    def given(docs, shingle):
        def run(batches):
            for batch in batches:
                node = [int(t) - (1 << 64 if int(t) >> 63 else 0) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64())], ["doc_id", "node"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, node bigint")

    monkeypatch.setattr(simhash, "fingerprints", given)
    got = simhash.linked(documents(docs), block_rows=block_rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == classes(list(enumerate(prints)))


def test_empty(spark, documents):
    assert simhash.linked(documents([])).count() == 0


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i % 301}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text) - (1 << 64 if plain_fingerprint(text) >> 63 else 0)
