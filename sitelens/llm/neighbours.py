"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

Terms are words and their first four to six letters; those that the labels of the
examples tell apart, by chi-squared, form the vocabulary. An example is its TF-IDF
vector over it. The index lists, per term, the blocks of examples that hold it with
the term's largest weight there. A query adds up these maxima into an upper bound per
block, scores blocks exactly from the best bound on, and stops when no bound beats
the ``k``-th similarity found: the neighbours are exact. They vote by squared
similarity against a prior weight for the share of positive examples that have no
vocabulary term at all; leave-one-out votes of the examples calibrate the result.

Near copies under one label, confirmed by their three-word windows, count as one
example. At most ``sample`` labelled rows outside the held-out fold become examples, chosen by
hash, and the vocabulary has at most ``max_terms`` terms, so the index is bounded and
goes to every task. All texts are scored whole.

Defined cases. A null or empty text, and one without vocabulary terms, has no
neighbours and gets the calibrated prior. Ties in similarity go to the example met
first in the index, whose order is fixed by the examples alone. Documents with several
labels take the majority. Without labelled rows every score is 0.5; with one label
only, it is that label's smoothed share. Repeated rows are scored each. An empty table
gives no rows. Further columns are kept; ``score`` and ``evidence`` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sitelens.llm.common import bounded_sample, fold, labelled, prepared
from sitelens.session import materialize

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6)
_BLOCK = 32
_LIFT = 4


def word_terms(word: str) -> list[str]:
    """A word as a term, and its beginnings."""
    return [word, *(word[:n] + "*" for n in _PREFIXES if len(word) >= n)]


def _document_terms(text: str | None) -> set[str]:
    return {t for w in set(_WORD.findall((text or "").lower())) for t in word_terms(w)}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples per term and label, added up within the task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(*(c.to_pylist() for c in batch.columns)):
            counts[y].update(_document_terms(text))
    terms = list(counts[0] | counts[1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)],
        ["term", "n0", "n1"],
    )


@F.pandas_udf(T.LongType())
def _sketch(texts: pd.Series) -> pd.Series:
    """The least hash of a text's three-word windows: near copies mostly share it."""

    def one(text: str | None) -> int:
        words = (text or "").lower().split()
        windows = (" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))
        return min(map(xxhash.xxh64_intdigest, windows)) - (1 << 63)

    return texts.map(one)


def _windows(text: str | None) -> set[str]:
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


@F.pandas_udf(T.DoubleType())
def _resemblance(texts: pd.Series, others: pd.Series) -> pd.Series:
    """Jaccard similarity of two texts' three-word windows."""

    def one(a: set[str], b: set[str]) -> float:
        return len(a & b) / len(a | b)

    return pd.Series([one(_windows(a), _windows(b)) for a, b in zip(texts, others)], dtype=float)


def distinct_examples(examples: DataFrame, least: float = 0.8) -> DataFrame:
    """One of the near copies under a label: a text that was copied a lot proves no more than once.

    Equal sketches only propose a copy; it goes if its windows resemble those of the
    one that is kept by ``least`` or more. Others of a group stay, less exact copies.
    """
    plain = F.array_join(F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+"), " ")
    once = (
        examples.groupBy("y", F.sha2(plain, 256).alias("_plain"))
        .agg(F.min(F.struct("doc_id", "text")).alias("first"))
        .select("first.doc_id", "first.text", "y")
    )
    groups = once.withColumn("sketch", _sketch("text"))
    kept = groups.groupBy("y", "sketch").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    # As many rows as the sample has at most; ids are unique in it, rows repeated under one are not.
    met = groups.join(kept, ["y", "sketch"]).withColumn("resemblance", _resemblance("text", "first.text"))
    copy = F.col("resemblance") >= least
    return (
        met.filter(~copy).select("doc_id", "text", "y").distinct()
        .unionByName(kept.select("first.doc_id", "first.text", "y"))
    )


def chosen_terms(
    examples: DataFrame, n0: int, n1: int, min_chi: float, min_share: float, max_terms: int
) -> list[tuple[str, int]]:
    """Terms, with their number of examples, that occur unevenly under the two labels.

    A term must occur in three examples and in ``min_share`` of those of one label,
    and there ``_LIFT`` times as often as under the other.
    """
    n = float(n0 + n1)
    counted = (
        examples.select("text", "y")
        .mapInArrow(_count_terms, "term string, n0 bigint, n1 bigint")
        .groupBy("term")
        .agg(F.sum("n0").cast("double").alias("a"), F.sum("n1").cast("double").alias("b"))
        .filter(f"a + b >= 3 AND (a >= {min_share * n0} OR b >= {min_share * n1})")
        .filter(f"abs(ln((a + 0.5D) / {n0} / ((b + 0.5D) / {n1}))) >= ln({_LIFT}D)")
    )
    chi = f"{n} * pow(b * ({n0} - a) - a * ({n1} - b), 2) / ({n0}D * {n1} * (a + b) * greatest({n} - a - b, 1))"
    top = (
        counted.withColumn("chi", F.expr(chi)).filter(F.col("chi") >= min_chi)
        .orderBy(F.col("chi").desc(), "term").limit(max_terms)
    )
    return [(r["term"], int(r["a"] + r["b"])) for r in top.collect()]


@dataclass
class Vectors:
    """Turns texts into unit TF-IDF vectors over the vocabulary; remembers words."""

    terms: dict[str, int]
    idf: np.ndarray
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return {"terms": self.terms, "idf": self.idf, "known": {}}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers in rising order, and their weights."""
        known, terms = self.known, self.terms
        if len(known) > 500_000:
            known.clear()
        counts: dict[int, int] = {}
        for word in _WORD.findall((text or "").lower()):
            hits = known.get(word)
            if hits is None:
                hits = known[word] = tuple(terms[t] for t in word_terms(word) if t in terms)
            for t in hits:
                counts[t] = counts.get(t, 0) + 1
        at = np.array(sorted(counts), np.int64)
        weights = np.array([1 + np.log(counts[t]) for t in at.tolist()]) * self.idf[at]
        return at, weights / max(np.sqrt((weights**2).sum()), 1e-12)


class BlockMaxIndex:
    """Examples in blocks, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # Examples led by the same term lie together: bounds are tight then.
        lead = [int(at[np.argmax(w)]) for at, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (lead[i], i)), np.int64)
        ordered = [vectors[i] for i in self.order]
        self.starts = np.cumsum([0, *(len(at) for at, _ in ordered)])
        self.terms = np.concatenate([at for at, _ in ordered] or [np.zeros(0, np.int64)])
        self.weights = np.concatenate([w for _, w in ordered] or [np.zeros(0)])
        self.rows = np.repeat(np.arange(len(ordered)), np.diff(self.starts))
        self.n_blocks = -(-len(ordered) // _BLOCK)
        key = self.terms * max(1, self.n_blocks) + self.rows // _BLOCK
        cells, cell_of = np.unique(key, return_inverse=True)
        self.maxima = np.zeros(len(cells))
        np.maximum.at(self.maxima, cell_of, self.weights)
        self.blocks = cells % max(1, self.n_blocks)
        self.bounds = np.searchsorted(cells // max(1, self.n_blocks), np.arange(n_terms + 1))
        self.query = np.zeros(n_terms)

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and similarities of the ``k`` nearest with a similarity above 0."""
        bound = np.zeros(self.n_blocks)
        for t, w in zip(at.tolist(), weights.tolist()):
            cells = slice(self.bounds[t], self.bounds[t + 1])
            bound[self.blocks[cells]] += w * self.maxima[cells]
        self.query[at] = weights
        best, sims, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= least:
                break
            first, last = block * _BLOCK, min((block + 1) * _BLOCK, len(self.order))
            part = slice(self.starts[first], self.starts[last])
            exact = np.bincount(
                self.rows[part] - first, self.weights[part] * self.query[self.terms[part]], last - first
            )
            found = np.flatnonzero(exact > least)
            found = found[self.order[found + first] != without]
            best, sims = np.concatenate([best, self.order[found + first]]), np.concatenate([sims, exact[found]])
            keep = np.argsort(-sims, kind="stable")[:k]
            best, sims = best[keep], sims[keep]
            least = float(sims[-1]) if len(sims) == k else 0.0
        self.query[at] = 0.0
        return best, sims


@dataclass
class Model:
    """Vocabulary, index, labels of the indexed examples, and the calibration."""

    vectors: Vectors
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    k: int
    weight: float = 0.05
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, best: np.ndarray, sims: np.ndarray) -> float:
        w = sims**2
        return float((w @ self.labels[best] + self.weight * self.prior) / (w.sum() + self.weight))

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(vote) + self.shift)))

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        at, weights = self.vectors(text)
        best, sims = self.index.nearest(at, weights, self.k)
        evidence = [
            {"doc_id": int(self.ids[b]), "similarity": float(s), "label": int(self.labels[b])}
            for b, s in zip(best[:3], sims[:3])
        ]
        return float(self.calibrated(np.array(self.vote(best, sims)))), evidence


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _platt(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, held near the identity by a weak prior."""
    x, beta = np.column_stack([_logit(votes), np.ones(len(votes))]), np.array([1.0, 0.0])
    start, ridge = beta.copy(), np.diag([1.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - ridge @ (beta - start)
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
    return max(0.1, float(beta[0])), float(beta[1])


def _vectorize(vectors: Vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vectors(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([a.tolist() for a, _ in found], pa.list_(pa.int64())),
                    pa.array([w.tolist() for _, w in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "y", "at", "w"],
            )

    return run


def fit(
    documents: DataFrame, learnt: DataFrame, sample: int = 16_000,
    max_terms: int = 8192, min_chi: float = 15.0,
    min_share: float = 0.02, k: int = 16,
) -> Model | None:
    """Model of ``learnt`` (``doc_id, y``) rows whose texts are in ``documents``; None without any."""
    prepared(documents.sparkSession)
    # Bounded by the parameter, so the sample's ids can be broadcast.
    ids = bounded_sample(learnt, "doc_id", sample).select(F.col("doc_id").alias("_id"), "y")
    examples = materialize(
        distinct_examples(
            documents.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select(
                F.col("_id").cast("bigint").alias("doc_id"), "text", "y"
            )
        ),
        "toxicity-examples",
    )
    sizes = {r["y"]: r["count"] for r in examples.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 + n1:
        return None
    terms = chosen_terms(examples, n0, n1, min_chi, min_share, max_terms) if n0 and n1 else []
    idf = np.log((n0 + n1 + 1) / (np.array([n for _, n in terms], np.float64) + 1))
    vectors = Vectors({t: i for i, (t, _) in enumerate(terms)}, idf)
    rows = sorted(
        examples.mapInArrow(_vectorize(vectors), "doc_id bigint, y int, at array<bigint>, w array<double>").collect(),
        key=lambda r: (r["doc_id"], r["y"], r["at"]),
    )
    filled = [r for r in rows if r["at"]]
    blank = [r["y"] for r in rows if not r["at"]]
    labels = np.array([r["y"] for r in filled], np.float64)
    # With one label only, this is its smoothed share.
    share = (n1 + 0.5) / (n0 + n1 + 1)
    prior = (sum(blank) + share) / (len(blank) + 1)
    index = BlockMaxIndex([(np.array(r["at"]), np.array(r["w"])) for r in filled], len(terms))
    model = Model(vectors, index, np.array([r["doc_id"] for r in filled]), labels, prior, k)
    if n0 and n1:
        votes = [
            model.vote(*index.nearest(np.array(r["at"]), np.array(r["w"]), k, without=i)) for i, r in enumerate(filled)
        ]
        model.slope, model.shift = _platt(np.array(votes + [prior] * len(blank)), np.append(labels, blank))
    return model


_RESULT = (
    T.StructType()
    .add("score", "double")
    .add("evidence", T.ArrayType(T.StructType().add("doc_id", "long").add("similarity", "double").add("label", "integer")))
)


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """``documents`` with ``score`` and ``evidence``, the three nearest examples."""
    spark = prepared(documents.sparkSession)
    rest = [c for c in documents.columns if c not in ("score", "evidence")]
    if model is None:
        return documents.select(
            *rest, F.lit(0.5).alias("score"), F.lit(None).cast(_RESULT["evidence"].dataType).alias("evidence")
        )
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.score(t) for t in texts], columns=["score", "evidence"])

    return documents.withColumn("_judged", judge("text")).select(*rest, "_judged.score", "_judged.evidence")


def toxicity(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2,
    threshold: float = 0.3, **settings,
) -> DataFrame:
    """``documents`` with ``held_out, score, predicted, evidence``."""
    learnt = labelled(labels, label).filter(fold("doc_id", folds) != held_out)
    judged = scored(documents, fit(documents, learnt, **settings))
    return judged.withColumns(
        {
            "held_out": F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)),
            "predicted": (F.col("score") >= threshold).cast("int"),
        }
    )
