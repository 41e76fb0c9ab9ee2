"""The two classifiers and the language-model scores."""

import math
import random

import numpy as np
import pytest

from sitelens.llm import entropy, gam, neighbours

LABELS = "doc_id BIGINT, quality INT, toxic INT, lang STRING"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


def corpus(rng, n):
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choices("aeinorst", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vilefoo", "vilebar,", "grumbaz"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(not bad), int(toxic)))
    return rows, marks


def test_quality(spark, documents, odd):
    rows, marks = corpus(random.Random(1), 400)
    extra = [(d + 1000 if d else d, t) for d, t in odd]
    df = documents(rows + extra)
    got = gam.quality_scores(df, labels(spark, [*marks, (1, None, None), (None, 1, 1), (99999, 0, 0)])).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {d: q for d, q, _ in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert 40 < len(held) < 140 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    # The same score for the same text, and no label of the held-out fold is used.
    flipped = [(d, 1 - q if any(h.doc_id == d for h in held) else q, t) for d, q, t in marks]
    again = gam.quality_scores(df, labels(spark, flipped)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in got) == sorted((r.doc_id or -1, r.score) for r in again)


def test_degenerate_labels(spark, documents):
    rows = [(i, f"text {i}") for i in range(8)]
    assert {r.score for r in gam.quality_scores(documents(rows), labels(spark, [])).collect()} == {0.5}
    ones = gam.quality_scores(documents(rows), labels(spark, [(i, 1, 1) for i in range(8)])).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.8
    assert gam.quality_scores(documents([]), labels(spark, [])).collect() == []
    assert {r.score for r in neighbours.toxicity(documents(rows), labels(spark, [])).collect()} == {0.5}
    toxic = neighbours.toxicity(documents(rows), labels(spark, [(i, 1, 1) for i in range(8)])).collect()
    assert len({r.score for r in toxic}) == 1 and toxic[0].score > 0.7
    assert neighbours.toxicity(documents([]), labels(spark, [(1, 1, 1)])).collect() == []


def test_pairs_are_learnt():
    rng = np.random.default_rng(0)
    values = rng.random((3000, len(gam.FEATURES)))
    y = ((values[:, 0] > 0.5) ^ (values[:, 3] > 0.5)).astype(float)
    model = gam.fit(values[:2000], y[:2000])
    assert (0, 3) in model.pairs or (3, 0) in model.pairs
    assert ((model.score(values[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    # A score is a sum of table entries.
    one = values[:1]
    total = model.base + sum(t[b[0]] for t, b in zip(model.tables, gam._binned(one, model.edges)))
    wide = gam._binned(one, model.coarse)
    total += sum(t[wide[i][0], wide[j][0]] for (i, j), t in model.pairs.items())
    assert model.score(one)[0] == pytest.approx(1 / (1 + math.exp(-total)))


def test_toxicity(spark, documents, odd):
    rows, marks = corpus(random.Random(2), 500)
    extra = [(d + 1000 if d else d, t) for d, t in odd]
    df = documents(rows + extra)
    judged = neighbours.toxicity(df, labels(spark, marks))
    # ``score`` of the input is replaced, everything else stays.
    assert set(judged.columns) == {*df.columns, "evidence", "held_out", "predicted"}
    got = judged.collect()
    truth = {d: t for d, _, t in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 50
    assert all(e.label == 1 for r in held if r.predicted for e in r.evidence[:1])


@pytest.mark.parametrize("seed", range(4))
def test_nearest_are_exact(seed):
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(300):
        at = np.unique(rng.integers(0, 60, rng.integers(1, 12)))
        w = rng.random(len(at))
        vectors.append((at, w / np.sqrt((w**2).sum())))
    index = neighbours.BlockMaxIndex(vectors, 60)
    dense = np.zeros((300, 60))
    for row, (at, w) in zip(dense, vectors):
        row[at] = w
    for i in range(0, 300, 17):
        best, sims = index.nearest(*vectors[i], 10, without=i)
        want = np.delete(dense @ dense[i], i)
        assert sims == pytest.approx(np.sort(want[want > 0])[::-1][:10])
        assert (dense @ dense[i])[best] == pytest.approx(sims)
    assert len(index.nearest(np.zeros(0, np.int64), np.zeros(0), 5)[0]) == 0


def plain_scores(rows, targets, word_bits, pair_bits, mass):
    """The same two models by dictionaries."""
    hashing = entropy.Hashing(word_bits, pair_bits)
    tokens = [tuple(x.tolist() for x in hashing(t)) for _, t in rows]
    models = []
    for wanted in ([True] * len(rows), [d in targets for d, _ in rows]):
        counts: dict[int, int] = {}
        for (word, pair, _), use in zip(tokens, wanted):
            for slot in word + pair if use else []:
                counts[slot] = counts.get(slot, 0) + 1
        models.append((counts, wanted, sum(len(t[0]) for t, use in zip(tokens, wanted) if use)))
    scale = models[1][2] / models[0][2]
    out = []
    for i, (doc, _) in enumerate(rows):
        word, pair, before = tokens[i]
        losses = []
        for (counts, wanted, total), factor in zip(models, (scale, 1.0)):
            mine = counts if not wanted[i] else {
                s: c - word.count(s) - pair.count(s) for s, c in counts.items()
            }
            size = (total - len(word) * wanted[i]) * factor
            sums = 0.0
            for w, p, b in zip(word, pair, before):
                cw, cp, cb = (mine.get(x, 0) * factor for x in (w, p, b))
                unigram = (cw + mass / hashing.words) / (size + mass)
                sums -= math.log((cp + mass * unigram) / (max(cb, cp) + mass))
            losses.append(sums / len(word) if word else 0.0)
        out.append((doc, len(word), losses[0] - losses[1]))
    return out


def test_cross_entropy_difference(spark, documents):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "Cc", "dd"] if i % 2 else ["aa", "ee", "ff"], k=rng.randint(1, 30)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "aa bb"), (52, "aa bb"), (None, "ee ff")]
    targets = {i for i in range(0, 40, 4)} | {52}
    ids = spark.createDataFrame([(i,) for i in [*targets, 999]], "doc_id BIGINT")
    got = entropy.score(documents(rows), ids, 8, 10).collect()
    mine = sorted(((r.doc_id, r.n_tokens, round(r.score, 9)) for r in got), key=repr)
    want = sorted(((d, n, round(s, 9)) for d, n, s in plain_scores(rows, targets, 8, 10, 8.0)), key=repr)
    assert mine == want
    even = [r.score for r in got if r.doc_id is not None and r.doc_id < 40 and r.doc_id % 2 == 0]
    odd_ones = [r.score for r in got if r.doc_id is not None and r.doc_id < 40 and r.doc_id % 2]
    assert sum(even) / len(even) > sum(odd_ones) / len(odd_ones)


def test_no_targets_and_no_documents(spark, documents, odd):
    none = spark.createDataFrame([], "doc_id BIGINT")
    got = entropy.score(documents(odd), none, 8, 10).collect()
    assert len(got) == len(odd) and {round(r.score, 9) for r in got} == {0.0}
    assert entropy.score(documents([]), none, 8, 10).collect() == []


def test_words_and_pairs_are_counted_apart(spark, documents):
    # More words than the 2 ** 16 classes that they were once folded into, in blocks of a few texts.
    rows = [(i, " ".join(f"w{i}x{j} the" for j in range(100))) for i in range(700)]
    rows += [(900 + i, f"rare{i} word rare{i + 1} word") for i in range(4)]
    ids = spark.createDataFrame([(i,) for i in range(0, 904, 3)], "doc_id BIGINT")
    got = entropy.score(documents(rows), ids, block_bytes=100_000).collect()
    mine = sorted((r.doc_id, r.n_tokens, round(r.score, 7)) for r in got)
    targets, words = set(range(0, 904, 3)), {w for _, t in rows for w in t.split()}
    assert len(words) > 1 << 16
    models = []
    for wanted in (range(904), targets):
        counts: dict = {}
        for d, t in rows:
            full = ["", *t.split()]
            for key in (*full[1:], *zip(full, full[1:])) if d in wanted else ():
                counts[key] = counts.get(key, 0) + 1
        models.append((counts, wanted, sum(n for k, n in counts.items() if isinstance(k, str))))
    scale, want = models[1][2] / models[0][2], []
    for d, t in rows:
        full, losses = ["", *t.split()], []
        own: dict = {}
        for key in (*full[1:], *zip(full, full[1:])):
            own[key] = own.get(key, 0) + 1
        for (counts, wanted, total), factor in zip(models, (scale, 1.0)):
            out = d in wanted
            size, loss = (total - (len(full) - 1) * out) * factor, 0.0
            for b, w in zip(full, full[1:]):
                cw, cp, cb = ((counts.get(k, 0) - own.get(k, 0) * out) * factor for k in (w, (b, w), b))
                loss -= math.log((cp + 8 * (cw + 8 / (len(words) + 1)) / (size + 8)) / (max(cb, cp) + 8))
            losses.append(loss / (len(full) - 1))
        want.append((d, len(full) - 1, round(losses[0] - losses[1], 7)))
    assert mine == sorted(want)


def test_counts_travel_packed(documents, spark, monkeypatch):
    """A row for each block and part, however many words and pairs they hold."""
    rng = np.random.default_rng(4)
    ends = [-(1 << 63), -1, 0, (1 << 63) - 1]
    for parts in (1, 2, 50):
        for drawn in ([], rng.integers(-(1 << 63), (1 << 63) - 1, 900)):
            keys = np.unique(np.concatenate([np.array(drawn, np.int64), np.array(ends)]))
            order, held, bounds = entropy._by_part(keys, parts)
            for part, s, e in zip(held.tolist(), bounds, bounds[1:]):
                packed = entropy._packed_keys(keys[order[s:e]], parts)
                assert entropy._unpacked_keys(packed, e - s, part, parts).tolist() == keys[order[s:e]].tolist()
    for values in ([0, 0], [3, 0, 255], [1, 300, 1 << 40]):
        assert entropy._unpacked(entropy._packed(np.array(values)), len(values)).tolist() == values
    written, write = [], entropy.materialize

    def watched(df, name):
        written.append(out := write(df, name))
        return out

    monkeypatch.setattr(entropy, "materialize", watched)
    rows = [(i, " ".join(f"w{i}x{j} the" for j in range(100))) for i in range(60)]
    ids = spark.createDataFrame([(3,)], "doc_id BIGINT")
    assert len(entropy.score(documents(rows), ids, block_bytes=10_000).collect()) == 60
    blocks = 1 + sum(len(t) for _, t in rows) // 10_000
    assert written[0].count() <= blocks * (1 + blocks // 2)


def test_only_confirmed_copies_are_dropped(spark):
    shared = " ".join(f"boiler{i} plate{i}" for i in range(12))
    texts = [f"{shared} {' '.join(f'own{d}x{i}' for i in range(12))}" for d in range(20)]
    rows = [(d, t, 1) for d, t in enumerate(texts)]
    rows += [(100 + d, t, 1) for d, t in enumerate(texts)] + [(200, None, 1), (201, "", 1), (202, texts[0], 0)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, y INT")
    got = sorted((r.doc_id, r.y) for r in neighbours.distinct_examples(df).collect())
    # Texts that share a passage stay, be it that their sketches meet; repeated texts under a kept one go.
    assert {(d, 1) for d in range(20)} | {(200, 1), (202, 0)} <= set(got)
    assert len(got) == 22
