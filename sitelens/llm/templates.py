"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other
numbers or names has the template of the original. Windows of ``window`` template
tokens of the benchmark are hash-joined with those of all documents. Where a document
holds enough of an item's windows, the two are aligned window by window, at each shift
where enough of them lie, and the slot values are compared: one value of the item must
stand for one value in the document and the other way round. An item of fewer tokens
is one window of its own length, with its slot values as they are: it is found verbatim.

Everything is built of native functions. The benchmark's windows are broadcast if
their counted number is below ``max_broadcast``; beyond it both sides are shuffled.

Defined cases. A null text, and one without tokens, has no windows: such an item finds
nothing, such a document is clean. Items without id take no part; documents without id
neither, since results are pairs of ids. Different texts under one id are searched each
for itself, on either side, and the best match of a pair of ids is reported; rows
repeated under one id count once. An empty table gives no rows. Further columns are
ignored; the result has its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.functions.sql import let, raw
from sitelens.session import materialize

# Units that may follow a number.
UNITS = (
    "mm|cm|m|km|in|inch|inches|ft|foot|feet|yd|yards?|miles?|mg|g|kg|tons?|oz|lbs?|pounds?|ml|l|liters?|litres?"
    "|gallons?|ms|s|secs?|seconds?|mins?|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|mph|kmh|hz|khz|mhz|ghz"
    "|kb|mb|gb|tb|w|kw|mw|v|degrees?|dollars?|cents?|euros?|percent|usd|eur"
)
#: Placeholders: private-use letters, which texts do not hold.
NUMBER, UNIT, NAME = "", "", ""

_DIGITS = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
#: A token without its placeholder.
_BARE = f"trim(LEADING '{NUMBER}{UNIT}{NAME}' FROM {{}})"


def _marked(text: str) -> str:
    """The text with a placeholder in front of each slot value."""
    units = f"regexp_replace({text}, {raw(f'({_DIGITS})[ -]?(?i:({UNITS}))' + chr(92) + 'b')}, '$1 {UNIT}$2')"
    money = f"regexp_replace({units}, {raw('([$€£%])')}, ' {UNIT}$1 ')"
    numbers = f"regexp_replace({money}, {raw(f'({_DIGITS})')}, ' {NUMBER}$1 ')"
    # A capital after a word or a comma does not begin a sentence; all capitals are no name.
    return f"regexp_replace({numbers}, {raw(r'(?<=[\p{Ll}\p{Nd},;] )(\p{Lu}\p{Ll}[\p{L}’-]*)')}, '{NAME}$1')"


def tokens(text: str) -> str:
    """Tokens in lower case; slots are a placeholder followed by their value."""
    apart = f"regexp_replace(lower({_marked(text)}), {raw(r'[^\p{L}\p{M}\p{Nd}-.,:/$€£%-]+|(?<!\p{Nd})[.,:/-]+|[.,:/-]+(?!\p{Nd})')}, ' ')"
    return f"array_remove(split({apart}, ' +'), '')"


def template(token_array: str) -> str:
    """Tokens with their slot values taken out."""
    return (
        f"transform({token_array}, w -> if(w >= '{NUMBER}' AND w < '', substring(w, 1, 1), w))"
    )


def _literal(token_array: str) -> str:
    """Tokens with their placeholders taken out."""
    return f"transform({token_array}, w -> {_BARE.format('w')})"


def _at(array: str, length: int) -> str:
    """``(pos, hash)`` of all windows of a length, in order."""
    hashes = f"transform(sequence(0, size({array}) - {length}), i -> xxhash64(slice({array}, i + 1, {length})))"
    return f"if(size({array}) < {length}, array(), transform({hashes}, (h, i) -> named_struct('pos', i, 'hash', h)))"


def _windows(text: str, window: int, lengths: list[int]) -> str:
    """``(pos, hash)`` of the template windows of a text, and of its literal ones of ``lengths``."""
    whole = lambda t: let(template(t), lambda x: _at(x, window))
    if not lengths:
        return let(tokens(text), whole)
    parts = lambda t: let(_literal(t), lambda x: f"concat({', '.join(_at(x, n) for n in lengths)})")
    return let(tokens(text), lambda t: f"concat({whole(t)}, {parts(t)})")


def _item_windows(window: int) -> str:
    """``(item_pos, hash)`` of an item's windows: the literal whole of one that is too short.

    Whether a text's first word is a name shows only from what stands before it, so
    template windows begin after it where the item has others.
    """
    named = lambda array: f"transform({array}, x -> named_struct('item_pos', x.pos, 'hash', x.hash))"
    later = lambda h: f"slice({h}, if(size({h}) > 1, 2, 1), greatest(1, size({h})))"
    whole = lambda t: let(let(template(t), lambda x: _at(x, window)), later)
    short = lambda t: f"array(named_struct('pos', 0, 'hash', xxhash64({_literal(t)})))"
    by_length = lambda t: f"CASE WHEN size({t}) >= {window} THEN {whole(t)} WHEN size({t}) > 0 THEN {short(t)} ELSE array() END"
    return named(let(tokens("item_text"), by_length))


def _slotted(mine: str, theirs: str) -> str:
    """Distinct ``(item value, document value)`` pairs of two aligned token arrays.

    Only in literal windows can the placeholders differ; the item's counts.
    """
    value = f"concat(substring(a, 1, 1), {_BARE.format('b')})"
    pairs = f"zip_with({mine}, {theirs}, (a, b) -> named_struct('a', a, 'b', {value}))"
    return f"filter({pairs}, x -> x.a >= '{NUMBER}' AND x.a < '')"


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 5,
    similarity: float = 0.8,
    max_broadcast: int = 500_000,
    insertion: int = 4,
) -> DataFrame:
    """``doc_id, item_id, similarity, n_slots, n_changed``: items that a document leaks.

    ``similarity`` is the share of an item's windows found in the document. A pair
    leaks if its slots are consistent in any alignment: at one shift between item and
    document, with up to ``insertion`` tokens more in between, or of first places.
    """
    # Texts are told apart within an id by their hash.
    items = (
        benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL")
        .selectExpr("item_id", "text AS item_text", "xxhash64(text) AS item_version")
        .distinct()
    )
    wanted = materialize(
        items.selectExpr(
            "item_id", "item_version", f"size({tokens('item_text')}) AS n_tokens", f"{_item_windows(window)} AS windows"
        ).selectExpr("item_id", "item_version", "n_tokens", "size(windows) AS n_windows", "inline(windows)"),
        "benchmark-windows",
    )
    small = wanted.limit(max_broadcast + 1).count() <= max_broadcast
    # Fewer lengths than a window has tokens.
    lengths = [r[0] for r in wanted.filter(F.col("n_tokens") < window).select("n_tokens").distinct().collect()]
    asked = wanted.select("hash").distinct()
    texts = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr(
        "cast(doc_id AS bigint) AS doc_id", "xxhash64(text) AS doc_version", "text"
    )
    held = texts.selectExpr(
        "doc_id", "doc_version", f"inline({_windows('text', window, sorted(lengths))}) AS (doc_pos, hash)"
    )
    # Few windows of a corpus are a benchmark's; only those travel on.
    met = materialize(held.join(F.broadcast(asked) if small else asked, "hash", "left_semi"), "benchmark-hits")
    pairs = met.join(F.broadcast(wanted) if small else wanted, "hash")
    pair = ["doc_id", "doc_version", "item_id", "item_version", "n_windows"]
    hits = pairs.select(
        *pair, "item_pos", "doc_pos", (F.col("doc_pos") - F.col("item_pos")).alias("shift")
    ).distinct()
    place = F.struct("item_pos", "doc_pos")
    # The first place of each window, however far apart they lie.
    anywhere = (
        hits.groupBy(*pair, "item_pos")
        .agg(F.min("doc_pos").alias("doc_pos"))
        .groupBy(*pair)
        .agg(F.sort_array(F.collect_list(place)).alias("found"))
    )
    # One alignment for each shift: windows at it or little after it, the nearest one of each.
    near = Window.partitionBy(*pair).orderBy("shift").rangeBetween(0, insertion)
    by_shift = hits.groupBy(*pair, "shift").agg(F.collect_list(place).alias("at"))
    in_order = "array_sort(flatten(collected), (l, r) -> CASE WHEN l.item_pos <> r.item_pos THEN l.item_pos - r.item_pos ELSE l.doc_pos - r.doc_pos END)"
    at_shift = (
        by_shift.withColumns({"collected": F.collect_list("at").over(near), "n_near": F.sum(F.size("at")).over(near)})
        .filter(F.col("n_near") >= similarity * F.col("n_windows"))
        .selectExpr(
            *pair,
            let(in_order, lambda x: f"filter({x}, (f, i) -> i = 0 OR {x}[i - 1].item_pos <> f.item_pos)") + " AS found",
        )
    )
    covered = (
        anywhere.unionByName(at_shift)
        .filter(F.size("found") >= similarity * F.col("n_windows"))
        .groupBy(*pair)
        .agg(F.collect_set("found").alias("alignments"))
    )
    # Only documents that hold an item's windows are read again, for their slot values.
    aligned = (
        covered.join(texts, ["doc_id", "doc_version"])
        .join(items, ["item_id", "item_version"])
        .selectExpr(
            *pair, "alignments", f"{tokens('item_text')} AS mine", f"{tokens('text')} AS theirs",
        )
    )
    # Bound by name: in a lambda, a column that is used once would be worked out each time.
    compared = let(
        "struct(mine, theirs)",
        lambda t: f"""transform(alignments, found -> named_struct('n_found', size(found), 'pairs',
            array_distinct(flatten(transform(filter(found,
            f -> f.doc_pos + least({window}, size({t}.mine)) <= size({t}.theirs)), f -> {_slotted(
                f'slice({t}.mine, f.item_pos + 1, {window})', f'slice({t}.theirs, f.doc_pos + 1, least({window}, size({t}.mine)))')})))))""",
    )
    slots = aligned.selectExpr("doc_id", "item_id", "n_windows", f"inline({compared})").selectExpr(
        "doc_id", "item_id", "n_found / n_windows AS similarity", "pairs"
    )
    return (
        slots.selectExpr(
            "doc_id", "item_id", "similarity",
            "size(array_distinct(transform(pairs, x -> x.a))) AS n_mine",
            "size(array_distinct(transform(pairs, x -> x.b))) AS n_theirs",
            "size(pairs) AS n_pairs",
            "size(filter(pairs, x -> x.a <> x.b)) AS n_changed",
        )
        # One value for one value, either way; copies of a window elsewhere may add a pair.
        .withColumn("consistent", F.expr("n_pairs <= n_mine + n_mine div 4 AND n_pairs <= n_theirs + n_theirs div 4"))
        .filter("consistent")
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("similarity").alias("similarity"),
            F.max("n_mine").cast("long").alias("n_slots"),
            F.min("n_changed").cast("long").alias("n_changed"),
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``documents`` without those that leak an item.

    Whether a document leaks is in its text alone, so texts are looked up by their hash:
    documents without id are cleaned too, and of two texts under one id only the leaking goes.
    """
    key = F.xxhash64(documents["text"])
    found = leaks(documents.select(key.alias("doc_id"), "text"), benchmark, **settings)
    leaking = materialize(found.select(F.col("doc_id").alias("leaking_text")).distinct(), "leaking-texts")
    return documents.join(leaking, key == leaking["leaking_text"], "left_anti")
