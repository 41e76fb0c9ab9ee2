"""Language-model scoring by cross-entropy difference.

Two bigram models, one of the target documents and one of all documents, share one
vocabulary and one form: pair probabilities are smoothed with the word probabilities,
those with the uniform one over the corpus's words. Background counts are scaled to the
target's number of tokens, so that both are smoothed alike. A document's score is the mean over
its tokens of background loss less target loss, in nats: above 0, it reads more like
the target than like the corpus.

Every word and pair of the corpus is counted on its own, under a 63-bit hash, so the
counts grow with the corpus. Documents are dealt into blocks of about ``block_bytes`` of
text. A block adds up its own texts and deals its keys to parts, half as many as blocks: one
row a part, with the keys as packed differences and the counts in as few bytes as they
need. A part sums its keys over the blocks; sums less the block's own counts go back in the
order of the block's keys, without the keys, and are written as a table. A block is then
scored with its own and the others' counts: no task holds more than a block of texts or a
part of the keys, a hot word is one number in each block, and the driver holds three sums.

Defined cases. Words are lower-cased; the word before the first is a start mark. A
null or empty text has no tokens and score 0, both losses are 0. Every document is
scored without its own counts in the models that count it, so that none vouches for
itself. Without target documents both models are the background and every score is 0.
Repeated rows count each for itself. An empty table gives no rows. Further columns are
ignored; the result has its own columns only. ``word_bits`` and ``pair_bits``, if given,
fold words and pairs into so many classes; without them nothing is folded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import prepared
from sitelens.session import materialize

_COUNTED = "block int, part int, n int, keys binary, background binary, target binary"
_SUMMED = "block int, part int, n int, background binary, target binary, own bigint, own_target bigint, words bigint"
_SCORED = "doc_id bigint, n_tokens bigint, loss_target double, loss_background double, score double"
_START = 1


class Hashing:
    """Word and pair keys of texts; words are remembered between texts, up to a bound."""

    def __init__(self, word_bits: int | None = None, pair_bits: int | None = None):
        self.words = None if word_bits is None else 1 << word_bits
        # Words lie at 0 and above; pairs below, or above the words where those are folded.
        self.word_shift = np.uint64(1 if word_bits is None else 64 - word_bits)
        self.pair_shift = np.uint64(1 if pair_bits is None else 64 - pair_bits)
        self.pairs_from = -(1 << 63) if self.words is None else self.words
        self.known: dict[bytes, int] = {}

    def is_word(self, keys: np.ndarray) -> np.ndarray:
        return (keys >= 0) & (keys < self.words) if self.words else keys >= 0

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of each token: its word, its pair with the word before, and that word."""
        tokens = (text or "").lower().encode().split()
        if len(self.known) > 1_000_000:
            self.known.clear()
        known = self.known
        for token in set(tokens).difference(known):
            known[token] = xxhash.xxh64_intdigest(token)
        full = np.empty(len(tokens) + 1, np.uint64)
        full[0], full[1:] = _START, np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        word = (full >> self.word_shift).astype(np.int64)
        mixed = (full[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ full[1:]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pair = (mixed >> self.pair_shift).astype(np.int64) + self.pairs_from
        return word[1:], pair, word[:-1]


class Block:
    """The tokens of a block's texts, end to end, with their documents' numbers."""

    def __init__(self, table: pa.Table, slots: Hashing):
        asked = table.column("asked").to_pylist()
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        targets = {i for i, a in zip(ids, asked) if a}
        self.ids = [i for i, a in zip(ids, asked) if not a]
        self.is_target = np.array([i in targets for i in self.ids], bool)
        tokens = [slots(t) for t, a in zip(texts, asked) if not a]
        self.sizes = np.array([len(word) for word, _, _ in tokens], np.int64)
        self.doc = np.repeat(np.arange(len(tokens)), self.sizes)
        self.word, self.pair, self.before = (
            np.concatenate([t[i] for t in tokens] or [np.zeros(0, np.int64)]) for i in range(3)
        )

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in rising order, how often the block holds them, and its target texts."""
        keys, at = np.unique(np.concatenate([self.word, self.pair]), return_inverse=True)
        mine = np.tile(self.is_target[self.doc], 2)
        return keys, np.bincount(at, minlength=len(keys)), np.bincount(at[mine], minlength=len(keys))


def _found(keys: np.ndarray, asked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the asked keys among ``keys``, which rise; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


def _packed(values: np.ndarray) -> bytes:
    """Numbers of 0 and above in as few bytes as the largest needs, lowest bytes of all first."""
    # Unsigned: two keys may lie more than half the range apart.
    whole = values.astype("<u8")
    width = (int(whole.max()).bit_length() + 7) // 8 if len(whole) else 0
    return whole.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(-1, n)
    full = np.zeros((n, 8), np.uint8)
    full[:, : len(planes)] = planes.T
    return full.view("<i8")[:, 0]


def _packed_keys(keys: np.ndarray, parts: int) -> bytes:
    """Rising keys of one part: what is left of them by ``parts``, the first as it is and then differences."""
    left = keys // parts
    return left[:1].astype("<i8").tobytes() + _packed(left[1:].view(np.uint64) - left[:-1].view(np.uint64))


def _unpacked_keys(packed: bytes, n: int, part: int, parts: int) -> np.ndarray:
    steps = _unpacked(packed[8:], n - 1) if n > 1 else np.zeros(0, np.int64)
    return np.cumsum(np.concatenate([np.frombuffer(packed, "<i8", 1), steps])) * parts + part


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the keys part by part, rising in each; the parts held, and their bounds."""
    part = keys % parts
    order = np.argsort(part, kind="stable")
    held, starts = np.unique(part[order], return_index=True)
    return order, held, np.append(starts, len(keys))


def _counter(hashing: tuple[int | None, int | None], parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, *counts = Block(table, Hashing(*hashing)).counts()
        order, held, bounds = _by_part(keys, parts)
        at = [order[s:e] for s, e in zip(bounds, bounds[1:])]
        return pa.table(
            {
                "block": pa.array(np.full(len(held), key[0].as_py(), np.int32)),
                "part": pa.array(held.astype(np.int32)),
                "n": pa.array(np.diff(bounds)[: len(held)].astype(np.int32)),
                "keys": pa.array([_packed_keys(keys[x], parts) for x in at[: len(held)]], pa.binary()),
                "background": pa.array([_packed(counts[0][x]) for x in at[: len(held)]], pa.binary()),
                "target": pa.array([_packed(counts[1][x]) for x in at[: len(held)]], pa.binary()),
            }
        )

    return run


def _summer(hashing: tuple[int | None, int | None], parts: int):
    """Counts of the other blocks, for each block in the order of its keys."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, sizes = key[0].as_py(), table.column("n").to_pylist()
        keys = np.concatenate([_unpacked_keys(x, n, part, parts) for x, n in zip(table.column("keys").to_pylist(), sizes)])
        distinct, at = np.unique(keys, return_inverse=True)
        words = Hashing(*hashing).is_word(keys)
        bounds = np.cumsum([0, *sizes])
        rows = {c: table.column(c) for c in ("block", "part", "n")}
        for name, own in (("background", "own"), ("target", "own_target")):
            mine = np.concatenate([_unpacked(x, n) for x, n in zip(table.column(name).to_pylist(), sizes)])
            # Summed as whole numbers: weights of bincount would be doubles.
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, at, mine)
            others = sums[at] - mine
            rows[name] = pa.array([_packed(others[s:e]) for s, e in zip(bounds, bounds[1:])], pa.binary())
            rows[own] = pa.array(np.add.reduceat(mine * words, bounds[:-1]))
        rows["words"] = pa.array([int(Hashing(*hashing).is_word(distinct).sum())] + [0] * (len(sizes) - 1), pa.int64())
        return pa.table(rows).select([f.split()[0] for f in _SUMMED.split(", ")])

    return run


def _scorer(hashing: tuple[int | None, int | None], parts: int, words: int, totals: tuple[int, int], mass: float):
    alone = not totals[1]
    scale = 1.0 if alone else totals[1] / max(1, totals[0])

    def run(key: tuple, table: pa.Table, others: pa.Table) -> pa.Table:
        block = Block(table, Hashing(*hashing))
        doc, sizes = block.doc, block.sizes
        keys, *own = block.counts()
        order, held, bounds = _by_part(keys, parts)
        place = {p: order[s:e] for p, s, e in zip(held.tolist(), bounds, bounds[1:])}
        models = [counts.copy() for counts in own]
        for part, *rest in zip(*(others.column(c).to_pylist() for c in ("part", "background", "target"))):
            for model, packed in zip(models, rest):
                model[place[part]] += _unpacked(packed, len(place[part]))
        # Each token's word, pair and word before: places among the keys, -1 for none.
        places = [_found(keys, x, np.arange(1, len(keys) + 1)) - 1 for x in (block.word, block.pair, block.before)]
        # What the documents themselves hold of these.
        codes = [doc * (len(keys) + 1) + at + 1 for at in places]
        held, times = np.unique(np.concatenate(codes[:2]), return_counts=True)
        inside = [_found(held, code, times) * (at >= 0) for code, at in zip(codes, places)]

        def loss(counts: np.ndarray, total: int, factor: float, counted: np.ndarray) -> np.ndarray:
            """Mean loss of each document; what it adds to a model that counts it is taken out first."""
            out = counted[doc]
            w, p, c = (
                (np.append(counts, 0)[at] - mine * out) * factor for at, mine in zip(places, inside)
            )
            size = ((total - sizes * counted) * factor)[doc]
            # Keys may collide: a pair is never more frequent than its first word.
            c = np.maximum(c, p)
            unigram = (w + mass / words) / (size + mass)
            sums = np.bincount(doc, -np.log((p + mass * unigram) / (c + mass)), len(sizes))
            return sums / np.maximum(sizes, 1)

        background = loss(models[0], totals[0], scale, np.ones(len(sizes), np.int64))
        target = background if alone else loss(models[1], totals[1], 1.0, block.is_target.astype(np.int64))
        return pa.table(
            {
                "doc_id": pa.array(block.ids, pa.int64()),
                "n_tokens": pa.array(sizes),
                "loss_target": pa.array(target),
                "loss_background": pa.array(background),
                "score": pa.array(background - target),
            }
        )

    return run


def score(
    documents: DataFrame,
    target_ids: DataFrame,
    word_bits: int | None = None,
    pair_bits: int | None = None,
    mass: float = 8.0,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Score all ``documents`` against those whose ``doc_id`` is in ``target_ids``.

    ``mass`` is the weight of the smoothing distribution, in counts.
    """
    prepared(documents.sparkSession)
    hashing = (word_bits, pair_bits)
    slots = Hashing(*hashing)
    size = documents.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = 1 + size // block_bytes
    # A target's id meets its text in the block; rows without id are dealt by their text.
    dealt = lambda *keys: F.pmod(F.xxhash64(F.lit("block"), *keys), F.lit(blocks)).cast("int").alias("block")
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    texts = documents.select(
        F.when(F.col("doc_id").isNull(), dealt(F.col("text"))).otherwise(dealt(F.col("doc_id").cast("bigint"))).alias("block"),
        doc_id, "text", F.lit(False).alias("asked"),
    ).unionByName(
        target_ids.filter("doc_id IS NOT NULL").select(
            dealt(F.col("doc_id").cast("bigint")), doc_id, F.lit(None).cast("string").alias("text"), F.lit(True).alias("asked")
        ).distinct()
    )
    grouped = texts.groupBy("block")
    parts = 1 + blocks // 2
    counts = materialize(
        grouped.applyInArrow(_counter(hashing, parts), _COUNTED).groupBy("part").applyInArrow(_summer(hashing, parts), _SUMMED),
        "language-model",
    )
    sums = counts.agg(
        F.sum("own").alias("background"), F.sum("own_target").alias("target"), F.sum("words").alias("words")
    ).head()
    totals = (sums["background"] or 0, sums["target"] or 0)
    words = slots.words or (sums["words"] or 0) + 1
    # Where no other block holds a key of the part, all counts are 0 and packed into no bytes.
    others = counts.filter("octet_length(background) > 0").select("block", "part", "background", "target")
    return grouped.cogroup(others.groupBy("block")).applyInArrow(_scorer(hashing, parts, words, totals, mass), _SCORED)
