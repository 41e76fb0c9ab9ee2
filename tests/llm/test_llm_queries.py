"""Training-data queries against their DuckDB twins, and what the others return."""

import pytest

from check import compare, twin
from sitelens.llm.oracles import ORACLES
from sitelens.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert compare(spark, twin(SF_DIR), name, SF_DIR) == ""


@pytest.mark.parametrize(
    "name, columns",
    [
        ("op1_gam_quality", {"doc_id", "held_out", "score", "predicted"}),
        ("op3_distribution_divergence", {"doc_id", "n_words", "n_repeat_words", "base_failed", "kept"}),
        ("op4_random_secrets", {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}),
        ("op5_source_mix", {"doc_id", "size", "source_size", "target", "taken"}),
        ("op7_nearest_toxicity", {"doc_id", "held_out", "score", "predicted"}),
        ("op8_ngram_jaccard", {"doc_id", "n_shingles", "component_id"}),
        ("op9_cross_entropy_difference", {"doc_id", "score"}),
    ],
)
def test_one_row_per_document(spark, name, columns):
    got = QUERIES[name](spark, SF_DIR)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert columns <= set(got.columns)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in documents.select("doc_id").collect())
