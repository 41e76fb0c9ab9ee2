"""Line deduplication against a plain recount."""

import random

import numpy as np

from sitelens.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def expected(rows, min_chars=20, min_docs=3):
    def key(line):
        return line.strip(BLANKS).encode().lower().decode()

    where = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                where.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            x for x in all_lines
            if doc is None or len(where.get(key(x), ())) < min_docs or max(where[key(x)]) == doc
        ]
        out.append((doc, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=repr)


def found(df, **settings):
    kept = lines.apply_bitmaps(df, lines.keep_bitmaps(df, **settings))
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in kept.collect()), key=repr)


def test_odd_rows(documents, odd):
    shared = "this line is long enough to count"
    rows = odd + [(20, shared), (21, f"x\n  {shared.upper()} \ny\n{shared}"), (22, shared + "\n"), (None, shared), (22, shared)]
    df = documents(rows)
    assert found(df) == expected(rows)
    kept = lines.apply_bitmaps(df, lines.keep_bitmaps(df))
    assert kept.columns == [*df.columns, "n_lines", "n_dropped"]


def test_hot_lines_over_many_partitions(spark, documents):
    rng = random.Random(3)
    pool = [f"shared line number {i} of the pool" for i in range(6)]
    rows = [(i, "\n".join(rng.choices(pool + [f"line of its own, number {i}"], k=rng.randint(1, 9)))) for i in range(500)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(documents(rows)) == expected(rows)
        assert found(documents(rows), min_docs=60) == expected(rows, min_docs=60)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_nothing_to_drop(documents):
    assert found(documents([])) == []
    assert found(documents([(1, "a line that nobody else has")])) == [(1, "a line that nobody else has", 1, 0)]


def test_bitmaps_keep_what_lies_beyond_them(documents):
    shared = "this line is long enough to count"
    rows = [(i, f"{shared}\nrest {i}\n" + "\n".join("tail" for _ in range(30))) for i in range(3)]
    maps = {r.doc_id: r.keep for r in lines.keep_bitmaps(documents(rows)).collect()}
    assert sorted(maps) == [0, 1]
    flags = lines.unpack(maps[0], 32)
    assert not flags[0] and flags[1:].all() and flags.dtype == np.bool_
