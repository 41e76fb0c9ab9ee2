"""Secret scans: fixed patterns, and strings that pass a battery of randomness tests.

Patterns are found natively with their places: the pieces between matches and the
matches themselves alternate, so running sums of their lengths are the places.
Strings without blanks that mix character kinds are candidates. The encoding is
inferred from the characters used, and three tests hold the candidate against
uniform draws from that alphabet: chi-squared over equal cells, Wald-Wolfowitz runs
about the middle, and serial correlation. Their p-values are combined by Fisher's
method. A candidate counts as ordinary text if the Benjamini-Hochberg step, taken by
encoding and length class over the whole corpus, rejects randomness; what is left is
reported. Short strings give the tests little power, therefore the length classes
and a minimum length per encoding.

The step needs no sort of all p-values: they are counted in bins per class, and the
cut is found on the counts.

Defined cases. A null text is empty. Places are code points, ends exclusive. Of two
found spans that overlap, the pattern's stays and the tested one goes. Rows repeated
under one id are scanned each for itself. An empty table gives no rows. Further
columns are ignored; the result has its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.functions.sql import let, raw
from sitelens.session import materialize

# The patterns asked for and the least length of what they find; in
# the first, group 2 is measured.
_ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = r"AKIA[A-Z0-9]+"
_HEX = r"[0-9a-f]+"
_LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

_CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encoding: what a string must consist of, what it must also hold, its alphabet in
#: order, and the least length at which the tests can tell it from text. The first
#: that fits is inferred.
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", r"[a-f].*[0-9]|[0-9].*[a-f]", _DIGITS + "abcdef", 24),
    "upper_hex": (r"^[0-9A-F]+$", r"[A-F].*[0-9]|[0-9].*[A-F]", _DIGITS + "ABCDEF", 24),
    "base32": (r"^[A-Z2-7]+=*$", r"[A-Z].*[2-7]|[2-7].*[A-Z]", _UPPER + "234567", 24),
    "base36": (r"^[a-z0-9]+$", r"[a-z].*[0-9]|[0-9].*[a-z]", _DIGITS + _LOWER, 24),
    "base64url": (
        r"^[A-Za-z0-9_-]+=*$",
        r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])",
        _UPPER + _LOWER + _DIGITS + "-_",
        20,
    ),
    "base64": (r"^[A-Za-z0-9+/]+=*$", r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", _UPPER + _LOWER + _DIGITS + "+/", 20),
}
_CELLS = 8
_BINS = 400  # of the p-value's logarithm, a twentieth of a decade each


def _prefix_sums(array: str) -> str:
    """Running sums of a BIGINT array, in as many passes as its length has bits."""
    step = (
        "zip_with(s, concat(array_repeat(0L, cast(d AS int)), slice(s, 1, cast(size(s) - d AS int))), (a, b) -> a + b)"
    )
    return (
        f"aggregate(transform(sequence(0, 30), k -> shiftleft(1L, k)), {array},"
        f" (s, d) -> if(d < size(s), {step}, s))"
    )


def _places(pattern: str, kind: int) -> str:
    """Matches of a pattern as ``(start, kind, end, found)`` structs."""

    def placed(found: str) -> str:
        gaps = f"split(t, {raw(pattern)}, -1)"
        lengths = f"zip_with({found}, slice({gaps}, 1, size({found})), (m, g) -> cast(length(m) + length(g) AS bigint))"
        ends = let(
            _prefix_sums(lengths),
            lambda e: f"transform({found}, (m, i) -> named_struct('start', {e}[i] - length(m), 'kind', {kind},"
            f" 'end', {e}[i], 'found', m))",
        )
        none = "cast(array() AS array<struct<start:bigint,kind:int,end:bigint,found:string>>)"
        return f"if(size({found}) = 0, {none}, {ends})"

    return let(f"regexp_extract_all(t, {raw(pattern)}, 0)", placed)


def scanned(documents: DataFrame) -> DataFrame:
    """``row, doc_id`` and the places found by each pattern: slim rows."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).selectExpr(
        "monotonically_increasing_id() AS row",
        "doc_id",
        f"filter({_places(_ASSIGN, 0)}, x -> length(regexp_extract(x.found, {raw(_ASSIGN)}, 2)) >= {_LEAST['assign']})"
        " AS assign",
        f"filter({_places(_ACCESS, 1)}, x -> length(x.found) >= {_LEAST['access']}) AS access",
        # A run of hex digits is matched as a whole, so short ones can be passed over.
        f"{_places(_HEX[:-1] + '{' + str(_LEAST['hex']) + ',}', 2)} AS hex",
        f"{_places(_CANDIDATE, 3)} AS candidates",
    )


def _normal_tail(z: str) -> str:
    """P(Z > z), Zelen and Severo's polynomial."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    upper = f"(exp(-pow({z}, 2) / 2) / sqrt(2 * pi()) * {poly})"
    return f"if({z} >= 0, {upper}, 1 - {upper})"


def _chi_tail(x: str, df: str) -> str:
    """P(chi-squared > x) by Wilson and Hilferty's cube root."""
    z = f"((pow(greatest({x}, 0D) / {df}, 1D / 3) - (1 - 2D / (9 * {df}))) / sqrt(2D / (9 * {df})))"
    return let(z, _normal_tail)


def tested(candidates: DataFrame) -> DataFrame:
    """Adds ``encoding, class, p``: the combined p-value of ``found`` being uniform draws.

    Strings that fit no encoding, or are too short for it, are left out.
    """
    core = "rtrim('=', found)"
    fits = " ".join(
        f"WHEN found RLIKE {raw(whole)} AND found RLIKE {raw(holds)}"
        f" THEN if(length({core}) >= {least}, named_struct('name', '{name}', 'alphabet', '{alphabet}'), NULL)"
        for name, (whole, holds, alphabet, least) in ENCODINGS.items()
    )
    sums = candidates.selectExpr("*", f"CASE {fits} END AS enc").filter("enc IS NOT NULL").selectExpr(
        "*",
        "enc.name AS encoding",
        "length(enc.alphabet) AS k",
        f"transform(filter(split({core}, ''), c -> c <> ''), c -> instr(enc.alphabet, c) - 1) AS codes",
    ).selectExpr("*", "size(codes) AS n").selectExpr(
        "*",
        # Cells differ by a letter at most where the alphabet does not divide evenly.
        f"transform(sequence(0, {_CELLS - 1}), j -> struct("
        f" cast(size(filter(codes, c -> c * {_CELLS} div k = j)) AS double) AS seen,"
        f" n * cast(size(filter(sequence(0, k - 1), c -> c * {_CELLS} div k = j)) AS double) / k AS due)) AS cells",
        "cast(size(filter(codes, c -> 2 * c >= k)) AS double) AS high",
        "1D + aggregate(zip_with(slice(codes, 2, n - 1), slice(codes, 1, n - 1),"
        " (b, a) -> if((2 * b >= k) <> (2 * a >= k), 1D, 0D)), 0D, (s, x) -> s + x) AS runs",
        "aggregate(codes, 0D, (s, c) -> s + c) / n AS mean",
    ).selectExpr(
        "*",
        "aggregate(cells, 0D, (s, x) -> s + pow(x.seen - x.due, 2) / x.due) AS chi",
        "2 * high * (n - high) / n + 1 AS runs_mean",
        "aggregate(codes, 0D, (s, c) -> s + pow(c - mean, 2)) AS var",
        "aggregate(zip_with(slice(codes, 2, n - 1), slice(codes, 1, n - 1), (b, a) -> (b - mean) * (a - mean)),"
        " 0D, (s, x) -> s + x) AS lagged",
    )
    runs_var = "greatest(1e-9D, (runs_mean - 1) * (runs_mean - 2) / (n - 1))"
    both = lambda z: f"2 * ({let(f'abs({z})', _normal_tail)})"
    parts = sums.selectExpr(
        "*",
        f"{_chi_tail('chi', str(_CELLS - 1))} AS p_chi",
        f"if(high = 0 OR high = n, 0D, {both(f'(runs - runs_mean) / sqrt({runs_var})')}) AS p_runs",
        f"if(var = 0, 0D, {both('lagged / var * sqrt(n)')}) AS p_serial",
    )
    fisher = "(-2 * (ln(greatest(p_chi, 1e-30D)) + ln(greatest(p_runs, 1e-30D)) + ln(greatest(p_serial, 1e-30D))))"
    return parts.selectExpr(
        *candidates.columns,
        "encoding",
        "concat(encoding, ' ', cast(floor(log2(n)) AS int)) AS class",
        f"{_chi_tail(fisher, '6')} AS p",
    )


def ordinary_cuts(candidates: DataFrame, rate: float) -> DataFrame:
    """``class, cut``: the largest bin whose p-values the step-up procedure still rejects."""
    binned = candidates.groupBy("class", "bin").count()
    upto = Window.partitionBy("class").orderBy("bin")
    whole = Window.partitionBy("class")
    return (
        binned.withColumn("rank", F.sum("count").over(upto))
        .withColumn("all", F.sum("count").over(whole))
        .filter(f"pow(10D, (bin - {_BINS}) / 20D) <= {rate} * rank / all")
        .groupBy("class")
        .agg(F.max("bin").alias("cut"))
    )


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return (
        f"array_join(transform(sort_array({spans}),"
        f" x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')"
    )


def secrets(documents: DataFrame, rate: float = 0.05) -> DataFrame:
    """Pattern counts and spans of every document, base and tested ones.

    ``rate`` bounds the share of truly random strings among those set aside as text.
    """
    # Written once: row numbers must stay, and the cuts need all candidates first.
    found = materialize(scanned(documents), "secret-places")
    base = "concat(assign, access, hex)"
    alone = found.selectExpr(
        "row",
        f"explode({let(base, lambda b: f'filter(candidates, c -> NOT exists({b}, x -> x.start < c.end AND c.start < x.end))')})"
        " AS c",
    ).select("row", "c.*")
    judged = materialize(
        tested(alone).selectExpr(
            "row", "start", "kind", "end", "found", "class",
            f"cast(greatest(0D, ceil({_BINS} + 20 * log10(greatest(p, 1e-20D)))) AS int) AS bin",
        ),
        "secret-tests",
    )
    random = (
        # A row per encoding and power of two of the length: a few hundred at most.
        judged.join(F.broadcast(ordinary_cuts(judged, rate)), "class", "left")
        .filter("cut IS NULL OR bin > cut")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end", "found")).alias("random"))
    )
    return found.join(random, "row", "left").selectExpr(
        "doc_id",
        "cast(size(assign) AS bigint) AS n_assign",
        "cast(size(access) AS bigint) AS n_access",
        "cast(size(hex) AS bigint) AS n_hex",
        f"sha2(cast({_joined(base)} AS binary), 256) AS base_sha256",
        f"{_joined(f'concat({base}, coalesce(random, array()))')} AS spans",
    )
