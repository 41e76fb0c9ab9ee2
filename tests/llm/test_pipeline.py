"""The pipeline over the smallest tables, each stage against a plain recount of its input."""

import re

import __spark_entry__ as entry
import corpus_pipeline
from sitelens.llm import neighbours
from sitelens.session import materialize

from test_jaccard import expected as joined
from test_lines import expected as deduplicated

SF_DIR = "/root/testdata/sf0.001"


def test_names_are_registered():
    numbers = sorted(int(m[1]) for m in map(re.compile(r"op(\d+)_").match, entry.queries()) if m)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing",
    ]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        docs = materialize(stage(spark, docs, SF_DIR), "test-stage")
        after = sorted((r.doc_id, r.text) for r in docs.collect())
        assert docs.columns == columns and after
        kept.append((before, after))
    judged = neighbours.toxicity(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert [d for d, _ in kept[0][1]] == sorted(r.doc_id for r in judged.filter("predicted = 0").collect())
    before, after = kept[1]
    assert after == sorted((d, t) for d, t, _, _ in deduplicated(before))
    before, after = kept[2]
    assert [d for d, _ in after] == sorted(d for d, n, c in joined(before, 5, 80) if not n or d == c)
    before, after = kept[3]
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    flat = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    leaking = {d for d, t in before if any(flat(i.text) in flat(t) for i in items)}
    assert leaking and not leaking & {d for d, _ in after}
    # Nothing goes that holds no whole item, unless most of one.
    assert len(before) - len(after) <= len(leaking) + 2
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert sorted(r.doc_id for r in mix) == [d for d, _ in after]
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", dict(after)[r.doc_id] or "")) for r in mix)


def test_run_is_its_stages(spark):
    once = sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF_DIR), "test-stage")
    assert once == sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()))


def test_odd_rows_pass(spark, odd):
    rows = [(d, t, "en", None if i % 2 else "s", None) for i, (d, t) in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF_DIR), "test-odd")
    left = {r.doc_id for r in docs.collect()}
    # 6 and 7 are copies, the rest is clean.
    assert left == {1, 2, 3, 4, 5, 6, 8, None}
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()) == docs.count()


def words(start, n=40):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_texts_under_one_id_are_documents_of_their_own(spark):
    """Columns may have the names that the stages use themselves."""
    rows = [
        (1, words(0), "a"), (1, words(1000), "b"), (2, words(0) + " x", "copy"), (2, words(2000), "c"), (3, words(2000), "copy"),
        (4, words(0), "copy"), (4, "", "d"), (None, words(0), "e"), (None, words(0), "f"), (5, words(3000), "g"), (5, words(3000), "h"),
    ]
    docs = spark.createDataFrame([(*r, r[2], r[2]) for r in rows], "doc_id BIGINT, text STRING, row STRING, _doc STRING, class STRING")
    docs = materialize(docs, "test-ids")
    got = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    assert got.columns == docs.columns
    assert sorted(r.row for r in got.collect()) == list("abcdefgh")


def test_input_columns_come_back_untouched(spark):
    schema = "predicted STRING, doc_id BIGINT, held_out STRING, text STRING, score STRING, evidence STRING, y STRING"
    docs = materialize(spark.createDataFrame([("p", 1, "h", words(0), "s", "e", "y")], schema), "test-columns")
    got = corpus_pipeline.toxicity(spark, docs, SF_DIR)
    assert got.columns == docs.columns and list(map(tuple, got.collect())) == [("p", 1, "h", words(0), "s", "e", "y")]


def test_leaks_without_id_go(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").head().text
    rows = [(None, f"{words(0)} {item} {words(50)}"), (None, words(0)), (None, None), (7, item), (8, words(9))]
    docs = materialize(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), "test-nameless")
    got = corpus_pipeline.decontamination(spark, docs, SF_DIR)
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, words(0)), (8, words(9))]
