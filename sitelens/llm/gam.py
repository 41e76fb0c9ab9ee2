"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow boosted trees visit one feature after the other, round after round. What all
trees of a feature add up to is one lookup table over its bins; pairs of features that
explain what the single tables leave get a table over both their bins. A score is a
sum of table entries, one per feature and pair, through the logistic function, so the
model can be read off its tables and scores a batch by vectorised additions.

Features are counted in one pass over whole texts; everything after works on slim
rows. The model is fit on a sample of at most ``sample`` labelled rows outside the
held-out fold, chosen by hash; all documents are scored.

Defined cases. A null or empty text has the features of an empty text and is scored
like any other. Documents with several labels take the majority. Without labelled
rows, or with one label only, every score is that label's share, or 0.5. Repeated rows
are scored each. An empty table gives no rows. Further columns are ignored; the result
has its own columns only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitelens.llm.common import bounded_sample, fold, labelled, prepared
from sitelens.session import materialize

FEATURES = (
    "log_words word_length unique_words repeated_next repeated_lines short_words upper_words upper digits symbols"
    " marks_end exclamations bars line_words stops_per_line non_ascii longest_share"
).split()

_SYMBOL = re.compile(r"[#*$%&<>@^~_{}\[\]\\]")
_DIGIT = re.compile(r"[0-9]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_MARKED = re.compile(r"[^\w.,;:!?\s\"')-]\s|[^\w.,;:!?\s\"')-]$")


def features(text: str | None) -> list[float]:
    """Shares and means of one text; all 0 without words."""
    words = (text or "").encode().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        len(counts) / n**0.8,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) <= 3 for w in words) / n,
        sum(map(bytes.isupper, words)) / n,
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        len(_SYMBOL.findall(text)) / chars,
        len(_MARKED.findall(text)) / n,
        text.count("!") / n,
        text.count("|") / n,
        float(np.log1p(n / max(1, len(lines)))),
        text.count(".") / max(1, len(lines)),
        (sum(map(len, words)) + n - chars) / chars,
        max(counts.values()) / n,
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column(1).to_pylist()]
        table = np.array(rows, np.float32).reshape(len(rows), len(FEATURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(table[:, i]) for i in range(len(FEATURES)))], ["doc_id", *FEATURES]
        )


def featured(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the features of every document."""
    prepared(documents.sparkSession)
    schema = "doc_id bigint, " + ", ".join(f"{f} float" for f in FEATURES)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_featured, schema)


@dataclass
class Gam:
    """Bin edges, one table per feature, and tables of feature pairs on coarser bins."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(values), self.base)
        if self.tables:
            bins = _binned(values, self.edges)
            total += sum(t[b] for t, b in zip(self.tables, bins))
            if self.pairs:
                wide = _binned(values, self.coarse)
                total += sum(t[wide[i], wide[j]] for (i, j), t in self.pairs.items())
        return 1 / (1 + np.exp(-total))


def _binned(values: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(e, values[:, i], side="right") for i, e in enumerate(edges)]


def _cuts(values: np.ndarray, n: int) -> list[np.ndarray]:
    shares = np.linspace(0, 1, n + 1)[1:-1]
    return [np.unique(np.quantile(column, shares, method="lower")) for column in values.T]


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf value per bin of a tree of the given depth over ordered bins."""
    whole = gradient.sum() / (weight.sum() + ridge)
    if depth and len(gradient) > 1:
        g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        rest_g, rest_w = gradient.sum() - g, weight.sum() - w
        gain = g**2 / (w + ridge) + rest_g**2 / (rest_w + ridge)
        at = int(np.argmax(gain)) + 1
        if gain[at - 1] > gradient.sum() ** 2 / (weight.sum() + ridge) + 1e-9:
            return np.concatenate(
                [_tree(gradient[:at], weight[:at], depth - 1, ridge), _tree(gradient[at:], weight[at:], depth - 1, ridge)]
            )
    return np.full(len(gradient), whole)


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values of a tree that splits one axis and then each half by the other; its gain."""
    best, values = -1.0, np.zeros_like(gradient)
    for flip in (False, True):
        g, w = (gradient.T, weight.T) if flip else (gradient, weight)
        for at in range(1, len(g)):
            halves = [(g[:at].sum(0), w[:at].sum(0)), (g[at:].sum(0), w[at:].sum(0))]
            leaves = [_tree(a, b, 1, ridge) for a, b in halves]
            gain = sum((v * (2 * a - v * (b + ridge))).sum() for v, (a, b) in zip(leaves, halves))
            if gain > best:
                best = gain
                grown = np.concatenate([np.tile(leaves[0], (at, 1)), np.tile(leaves[1], (len(g) - at, 1))])
                values = grown.T if flip else grown
    return values, best


def fit(
    values: np.ndarray,
    labels: np.ndarray,
    rounds: int = 150,
    pair_rounds: int = 30,
    n_pairs: int = 6,
    bins: int = 64,
    pair_bins: int = 8,
    rate: float = 0.15,
    ridge: float = 4.0,
) -> Gam:
    """Cyclic boosting of the feature tables, then of the tables of the strongest pairs."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Gam(float(np.log(share / (1 - share))))
    if len(np.unique(labels)) < 2:
        return model
    model.edges, model.coarse = _cuts(values, bins), _cuts(values, pair_bins)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = _binned(values, model.edges)
    total = np.full(len(labels), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i, table in enumerate(model.tables):
            g, w = slopes()
            n = len(table)
            step = rate * _tree(np.bincount(at[i], g, n), np.bincount(at[i], w, n), 2, ridge)
            table += step
            total += step[at[i]]
    wide = _binned(values, model.coarse)
    sizes = [len(e) + 1 for e in model.coarse]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, w = slopes()
        cell, n = wide[i] * sizes[j] + wide[j], sizes[i] * sizes[j]
        return (np.bincount(cell, x, n).reshape(sizes[i], sizes[j]) for x in (g, w))

    ranked = sorted(
        ((_pair_tree(*grids(i, j), ridge)[1], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True
    )
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for _, i, j in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * _pair_tree(*grids(i, j), ridge)[0]
            table += step
            total += step[wide[i], wide[j]]
    return model


def _scorer(model: Gam):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(values))], ["doc_id", "score"]
            )

    return run


def quality_scores(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.3,
    sample: int = 30_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    slim = materialize(featured(documents), "gam-features")
    learnt = labelled(labels, label).filter(fold("doc_id", folds) != held_out)
    rows = bounded_sample(slim.join(learnt, "doc_id").dropDuplicates(["doc_id"]), "doc_id", sample).toArrow()
    model = Gam(0.0)
    if rows.num_rows:
        values = np.column_stack([rows.column(f).to_numpy() for f in FEATURES])
        model = fit(values, rows.column("y").to_numpy().astype(np.float64))
    return slim.mapInArrow(_scorer(model), "doc_id bigint, score double").select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
