"""Mix sources to target weights in fixed-length token blocks.

Each source is a stream of tokens, its documents in a pseudorandom order, cut into
blocks of ``block`` tokens. The output is a row of shards with a fixed number of
slots. Each shard draws its multinomial source counts by stratified uniforms, one
per slot. A slot is numbered inside its source, and a keyed permutation of the
source's block numbers, another one for each pass over the source, maps the number
to a block. Slots and blocks then join by source and block number: ``Mix.shards`` gives
the slots with their tokens, ``Mix.taken`` what they take of each document.

Numbers inside a source come from sums over hash buckets (or shards) plus a running
sum over the bucket totals, so no task sees a whole source. Everything is built of
native functions.

Defined cases. A document's size is its number of words; null texts have size 0 and
are never taken, they return with taken 0. Null is a source of its own, last in
order. Sources without any words have target 0. Rows repeated under one id are
documents of their own and return one row each. An empty table gives no rows.
Further columns are ignored; the results have their own columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sitelens.llm.common import words
from sitelens.session import materialize

#: Weights of the sources in order, repeating; and passes over a source at most.
WEIGHTS = (1, 2, 3)
PASSES = 3


def source_targets(totals: list[tuple], weights: tuple = WEIGHTS, passes: int = PASSES) -> list[float]:
    """Target words of each ``(source, words)``, in the order given.

    Targets share all words by weight. One that exceeds ``passes`` times its
    source's words stops there and its excess is shared among the others again.
    """
    sizes = [n for _, n in totals]
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    targets = [0.0] * len(sizes)
    free, rest = {i for i, n in enumerate(sizes) if n}, float(sum(sizes))
    while free:
        unit = rest / sum(share[i] for i in free)
        full = {i for i in free if unit * share[i] > passes * sizes[i]}
        for i in full or free:
            targets[i] = float(passes * sizes[i]) if full else unit * share[i]
        if not full:
            break
        rest -= sum(targets[i] for i in full)
        free -= full
    return targets


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) drawn by hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def permuted(index: str, n: str, key: str) -> Column:
    """A pseudorandom permutation of 0 to ``n - 1``, keyed by ``key``.

    A Feistel network over two digits, of bases ``a = ceil(sqrt n)`` and
    ``b = ceil(n / a)``; what lands at ``n`` or above goes through it again. Fewer
    than ``a`` numbers lie there, so 64 turns never run out.
    """
    a, b = f"ceil(sqrt({n}))", f"ceil({n} / ceil(sqrt({n})))"

    def turn(x: str) -> str:
        left, right = f"({x} % _p.a)", f"({x} div _p.a)"
        pair = f"named_struct('l', {left}, 'r', {right})"
        for i in range(4):
            if i % 2:
                step = f"named_struct('l', s.l, 'r', (s.r + pmod(xxhash64({key}, {i}, s.l), _p.b)) % _p.b)"
            else:
                step = f"named_struct('l', (s.l + pmod(xxhash64({key}, {i}, s.r), _p.a)) % _p.a, 'r', s.r)"
            pair = f"transform(array({pair}), s -> {step})[0]"
        return f"transform(array({pair}), s -> s.l + s.r * _p.a)[0]"

    return F.expr(
        f"transform(array(named_struct('a', cast({a} AS bigint), 'b', cast({b} AS bigint))), _p ->"
        f" aggregate(sequence(1, 64), {turn(f'cast({index} AS bigint)')},"
        f" (acc, i) -> if(acc < {n}, acc, {turn('acc')})))[0]"
    )


def _running(df: DataFrame, group: str, bucket: str, amount: str, out: str) -> DataFrame:
    """Adds the sum of ``amount`` over the group's earlier buckets."""
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long"))


def _streams(sizes: DataFrame, buckets: int) -> DataFrame:
    """``row_id, sid, start, size``: where each document lies in its source's stream."""
    placed = sizes.filter("size > 0").select(
        "row_id", "sid", "size", "place"
    ).withColumn("bucket", F.expr(f"cast(floor((place / 18446744073709551616D + 0.5D) * {buckets}) AS int)"))
    offsets = _running(
        placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words")), "sid", "bucket", "words", "offset"
    ).select("sid", "bucket", "offset")
    inside = (
        Window.partitionBy("sid", "bucket")
        .orderBy("place", "row_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.hint("merge"), ["sid", "bucket"])
        .select("row_id", "sid", (F.col("offset") + F.col("inside")).alias("start"), "size")
    )


def slots(spark: SparkSession, plan: list[dict], shard_slots: int, seed: int) -> DataFrame:
    """``sid, block, shard, slot, turn``: the block that each slot takes, and in which pass.

    ``plan`` has per source ``sid``, its number of ``blocks`` and the number of
    ``draws`` its target asks for.
    """
    total = sum(p["draws"] for p in plan)
    n_slots = max(1, round(total))
    shards = -(-n_slots // shard_slots)
    cut, bounds = 0.0, []
    for p in plan:
        bounds.append(cut / total)
        cut += p["draws"]
    # The plan has a row per source; it becomes literal arrays.
    array = lambda values: F.array(*map(F.lit, values))
    drawn = (
        spark.range(shards)
        .select(F.col("id").alias("shard"), F.explode(F.expr(
            f"sequence(0L, least({shard_slots}L, {n_slots}L - id * {shard_slots}L) - 1)")).alias("slot"))
        .withColumn("width", F.least(F.lit(shard_slots), F.lit(n_slots) - F.col("shard") * shard_slots))
        .withColumn("u", (F.col("slot") + _uniform(F.lit(seed), F.col("shard"), F.col("slot"))) / F.col("width"))
        .withColumn("bounds", array(bounds))
        .withColumn("sid", F.expr("size(filter(bounds, b -> b <= u)) - 1"))
        .select("shard", "slot", "sid")
    )
    counts = drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    first = _running(counts, "sid", "shard", "n", "first").drop("n")
    inside = Window.partitionBy("shard", "sid").orderBy("slot")
    numbered = (
        drawn.withColumn("k", F.row_number().over(inside) - 1)
        # Rows made by explode are estimated far too low; these sides grow with the data.
        .join(first.hint("merge"), ["shard", "sid"])
        .select("shard", "slot", "sid", (F.col("first") + F.col("k")).alias("index"))
        .withColumn("blocks", array([p["blocks"] for p in plan])[F.col("sid")])
        .withColumn("turn", F.expr("index div blocks"))
        # Stratified draws miss a count by a few slots at most; none passes the limit.
        .filter(F.col("turn") < PASSES)
        .withColumn("at", F.expr("index % blocks"))
    )
    return numbered.select(
        "sid", permuted("at", "blocks", f"{seed}, sid, turn").alias("block"), "shard", "slot", "turn"
    )


class Mix:
    """A mix that is planned: where each document lies in its source, and the slots of the shards."""

    def __init__(self, documents: DataFrame, block: int, shard_slots: int, seed: int, rows_per_bucket: int):
        spark = documents.sparkSession
        self.block = block
        # Written once: the number that tells repeated rows apart must stay with its text.
        self.rows = materialize(
            documents.select(
                "doc_id",
                "source",
                "text",
                F.size(words("text")).cast("long").alias("size"),
                # The order of a stream follows from the rows, not from how they were read.
                F.xxhash64(F.lit("order"), "doc_id", "text").alias("place"),
                F.monotonically_increasing_id().alias("row_id"),
            ),
            "mix-rows",
        )
        sizes = self.rows.drop("text")
        # One row per source, a bounded list by nature.
        totals = sorted(
            (
                (r["source"], r["size"], r["n"])
                for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
            ),
            key=lambda r: (r[0] is None, r[0] or ""),
        )
        targets = source_targets([r[:2] for r in totals])
        known = [
            {"sid": i, "source": s, "source_size": n, "target": t, "blocks": -(-n // block),
             "draws": t * -(-n // block) / n if n else 0.0}
            for i, ((s, n, _), t) in enumerate(zip(totals, targets))
        ]
        self.plan = spark.createDataFrame(
            [(p["sid"], p["source"], p["source_size"], p["target"]) for p in known],
            "sid int, source string, source_size long, target double",
        )
        self.placed = sizes.join(F.broadcast(self.plan), sizes["source"].eqNullSafe(self.plan["source"])).drop("source")
        self.streams = self.slots = None
        if any(p["draws"] for p in known):
            buckets = max(1, -(-sum(r[2] for r in totals) // rows_per_bucket))
            self.streams = _streams(self.placed, buckets)
            self.slots = slots(spark, known, shard_slots, seed)

    def parts(self, streams: DataFrame, *columns: str | Column) -> DataFrame:
        """A row for each block that a document lies in, with the stretch that it has there."""
        parts = streams.select(
            "row_id", "sid", "start", "size", *columns,
            F.explode(F.expr(f"sequence(start div {self.block}, (start + size - 1) div {self.block})")).alias("block"),
        )
        return parts.withColumns(
            {
                "since": F.expr(f"greatest(start, block * {self.block})"),
                "overlap": F.expr(
                    f"least(start + size, (block + 1) * {self.block}) - greatest(start, block * {self.block})"
                ),
            }
        )

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every document."""
        columns = ("doc_id", "size", "source_size", "target")
        if self.streams is None:
            return self.placed.select(*columns, F.lit(0).cast("long").alias("taken"))
        times = self.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
        taken = (
            self.parts(self.streams)
            .join(times.hint("merge"), ["sid", "block"])
            .groupBy("row_id")
            .agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
        )
        return self.placed.join(taken.hint("merge"), "row_id", "left").select(
            *columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )

    def shards(self) -> DataFrame:
        """``shard, slot, source, block, pass, tokens``: the mix, one row per slot.

        ``tokens`` are the words of the block in stream order; the last block of a
        source may be shorter. Order by ``shard`` and ``slot`` to write shards.
        """
        if self.streams is None:
            return self.plan.filter("false").selectExpr(
                "0L AS shard", "0L AS slot", "source", "0L AS block", "0 AS pass", "array('') AS tokens"
            )
        texts = self.rows.select("row_id", words("text").alias("words"))
        streams = self.streams.join(texts.hint("merge"), "row_id")
        # Each block is cut from the texts once, of at most as many parts as it has tokens.
        blocks = (
            self.parts(streams, "words")
            .select("sid", "block", "since", F.expr("slice(words, cast(since - start + 1 AS int), cast(overlap AS int))").alias("part"))
            .groupBy("sid", "block")
            .agg(F.sort_array(F.collect_list(F.struct("since", "part"))).alias("parts"))
            .selectExpr("sid", "block", "flatten(parts.part) AS tokens")
        )
        return (
            self.slots.join(blocks.hint("merge"), ["sid", "block"])
            .join(F.broadcast(self.plan.select("sid", "source")), "sid")
            .select("shard", "slot", "source", "block", F.col("turn").cast("int").alias("pass"), "tokens")
        )


def planned(
    documents: DataFrame, block: int = 32, shard_slots: int = 1024, seed: int = 7, rows_per_bucket: int = 2_000
) -> Mix:
    """The mix of ``documents``: its ``shards()`` are the training data, ``taken()`` sums them by document."""
    return Mix(documents, block, shard_slots, seed, rows_per_bucket)


def mix(documents: DataFrame, **settings) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    return planned(documents, **settings).taken()
