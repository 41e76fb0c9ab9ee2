"""Quality rules: does a document look like its language?

Every document gets two histograms: characters by class, and the common words of
the four languages with all other words as one more bin. Sums over all documents of
a language give that language's references, smoothed by some counts of all languages
together, and a document is held against the references of its own ``lang`` by
Jensen-Shannon distance. Small samples lie far from any reference by chance, and small
references from any sample, so the limit grows as the expected distance of two samples
of these lengths does: however little text a language has, its documents are tested,
by a limit that narrows as the text grows. A minimum length guards either comparison.
Texts are read once, natively; what follows works on one slim row per document.

Defined cases. A null text has no words. Null ``lang`` has no reference: only the base
rules decide; such texts count towards all languages together. Rows
repeated under one id are judged each for itself. An empty table gives no rows.
Further columns are ignored; the result has its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelens.functions.sql import each, keep, let, raw, text as quoted
from sitelens.llm.common import words
from sitelens.session import materialize

# The symbols that are counted, and frequent short words by language.
SYMBOLS = "#*$%&|<>"
COMMON_WORDS = (
    *"the of and to in a is that for it with on be by".split(),
    *"der die das und ist ein eine nicht mit von zu auf sich den".split(),
    *"le la les des et est un une que pour dans sur du de".split(),
    *"el los las y que por con para una se del no es de".split(),
)
_VOCABULARY = tuple(dict.fromkeys(COMMON_WORDS))

#: Character classes besides blanks; lower-case a to z is what these leave.
CLASSES = {
    "upper": r"\p{Lu}",
    "other_letter": r"[\p{L}&&[^a-z\p{Lu}]]",
    "digit": r"\p{Nd}",
    "stop": r"[.,;:!?()\x22\x27-]",
    "symbol": r"[#*$%&|<>@_/\\=+~^{}\[\]]",
}
_N_CLASSES = len(CLASSES) + 2


def _count(pattern: str) -> str:
    """Characters of ``t`` in a class; the classes are rare, so little is rewritten."""
    return f"length(t) - length(regexp_replace(t, {raw(pattern + '+')}, ''))"


def repeat_words(array: str) -> str:
    """Words of an array that lie in a three-word window found at least twice in it.

    Windows are compared by hash. Sorting (hash, place) pairs brings equal windows
    together; the places of repeated ones, sorted, then cover three words each, less
    what the next one covers.
    """

    def covered(places: str) -> str:
        ends = f"slice({places}, 2, size({places}) - 1)"
        steps = f"zip_with({ends}, slice({places}, 1, size({places}) - 1), (b, a) -> least(3, b - a))"
        return f"if(size({places}) = 0, 0, 3 + aggregate({steps}, 0, (n, x) -> n + x))"

    def repeated(pairs: str) -> str:
        mates = (
            f"filter({pairs}, (x, i) -> (i > 0 AND {pairs}[i - 1].h = x.h)"
            f" OR (i < size({pairs}) - 1 AND {pairs}[i + 1].h = x.h))"
        )
        return let(f"sort_array(transform({mates}, x -> x.i))", covered)

    def windows(hashes: str) -> str:
        pairs = f"sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))"
        return f"if(size(array_distinct({hashes})) = size({hashes}), 0, {let(pairs, repeated)})"

    def hashed(w: str) -> str:
        hashes = f"transform(sequence(0, size({w}) - 3), i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2]))"
        return f"if(size({w}) < 4, 0, {let(hashes, windows)})"

    return f"cast({let(array, hashed)} AS bigint)"


def measured(documents: DataFrame) -> DataFrame:
    """One slim row per document: base counts and both histograms."""
    read = documents.select(
        "doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"), words("text").alias("w")
    )
    vocabulary = ", ".join(map(quoted, _VOCABULARY))
    found = keep(f"split(lower(t), {raw('[^' + chr(92) + 'p{L}]+')})", lambda x: f"{x} IN ({vocabulary})")
    # One letter per common word, so that a bin is counted by taking its letter out.
    letters = each(found, lambda x: f"chr(int(64 + array_position(array({vocabulary}), {x})))")
    counted = let(
        f"array_join({letters}, '')",
        lambda s: each(
            f"sequence(1, {len(_VOCABULARY)})", lambda i: f"length({s}) - length(replace({s}, chr(64 + {i}), ''))"
        ),
    )
    lines = keep(r"split(t, '\n')", lambda x: f"{x} RLIKE {raw('[^' + chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D]')}")
    return read.selectExpr(
        "doc_id",
        "lang",
        "cast(size(w) AS bigint) AS n_words",
        "cast(length(array_join(w, '')) AS bigint) AS word_chars",
        f"cast({_count('[' + SYMBOLS + ']')} AS bigint) AS n_symbols",
        f"cast({let(lines, lambda x: f'size({x}) - size(array_distinct({x}))')} AS bigint) AS n_dup_lines",
        f"{repeat_words('w')} AS n_repeat_words",
        f"transform(array({', '.join(map(_count, CLASSES.values()))}, length(t) - length(array_join(w, ''))),"
        " n -> cast(n AS bigint)) AS chars",
        "length(t) AS n_chars",
        f"transform({counted}, n -> cast(n AS bigint)) AS common",
    ).withColumns(
        {
            "chars": F.expr(f"concat(chars, array(greatest(0, n_chars - {_total('chars')})))"),
            "common": F.expr(f"concat(common, array(greatest(0, n_words - {_total('common')})))"),
        }
    )


def _total(array: str) -> str:
    return f"aggregate({array}, 0L, (n, x) -> n + x)"


def references(slim: DataFrame, smoothing: float) -> DataFrame:
    """``lang, ref_*, size_*`` for ``chars`` and ``common``: shares per bin and items counted.

    Shares are those of all documents of a language with ``smoothing`` items more, spread
    as in all documents. One row of as many numbers as there are bins goes to the driver.
    """
    bins = {"chars": _N_CLASSES, "common": len(_VOCABULARY) + 1}
    sums = materialize(
        slim.groupBy("lang").agg(*(F.sum(F.col(b)[i]).alias(f"{b}{i}") for b, n in bins.items() for i in range(n))),
        "language-histograms",
    )
    pooled = sums.agg(*(F.sum(c).alias(c) for c in sums.columns if c != "lang")).head()
    columns = ["lang"]
    for b, n in bins.items():
        own = f"array({', '.join(f'{b}{i}' for i in range(n))})"
        every = [pooled[f"{b}{i}"] or 0 for i in range(n)]
        prior = ", ".join(f"{smoothing * x / max(1, sum(every))!r}D" for x in every)
        columns += [
            f"zip_with({own}, array({prior}), (x, y) -> (x + y) / ({_total(own)} + {smoothing})) AS ref_{b}",
            f"{_total(own)} AS size_{b}",
        ]
    return sums.filter("lang IS NOT NULL").selectExpr(*columns)


def distance(counts: str, reference: str) -> str:
    """Jensen-Shannon distance, base 2, of counts from reference shares."""

    def part(p: str, q: str) -> str:
        return f"if({p} > 0, {p} * log2(2 * {p} / ({p} + {q})), 0D)"

    terms = f"zip_with({counts}, {reference}, (c, q) -> {let('c / n', lambda p: part(p, 'q') + ' + ' + part('q', p))})"
    summed = f"sqrt(greatest(0D, aggregate({terms}, 0D, (s, x) -> s + x) / 2))"
    return f"if({reference} IS NULL, NULL, transform(array({_total(counts)}), n -> {summed})[0])"


def quality_rules(
    documents: DataFrame,
    min_words: int = 50,
    max_chars_distance: float = 0.17,
    max_common_distance: float = 0.16,
    spread: float = 0.5,
    smoothing: float = 100,
) -> DataFrame:
    """Base counts, both distances and the verdict of every document.

    A distance may reach its limit plus ``spread`` times the distance that samples of
    ``n`` and ``m`` items from ``k`` bins have by chance, ``sqrt(k (1/n + 1/m) / (8 ln 2))``.
    """
    # Written once: the references need all rows before any is judged.
    slim = materialize(measured(documents), "histograms")
    chance = lambda k, n, m: f"{spread} * sqrt({k} * (1D / {n} + 1D / {m}) / (8 * ln(2D)))"
    judged = slim.join(references(slim, smoothing), "lang", "left").selectExpr(
        "*",
        f"n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed",
        f"if(n_words >= {min_words}, {distance('chars', 'ref_chars')}, NULL) AS chars_distance",
        f"if(n_words >= {min_words}, {distance('common', 'ref_common')}, NULL) AS common_distance",
    )
    return judged.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        f"""NOT base_failed
            AND coalesce(chars_distance <= {max_chars_distance} + {chance(_N_CLASSES, 'word_chars', 'size_chars')}, true)
            AND coalesce(common_distance <= {max_common_distance} + {chance(len(_VOCABULARY), 'n_words', 'size_common')}, true)
            AS kept""",
        "chars_distance", "common_distance",
    )
