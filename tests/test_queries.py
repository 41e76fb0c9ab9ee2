"""Every query against its DuckDB twin on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, twin
from sitelens.plans.queries import QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return twin(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == ""


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_budgets_reach_and_cut_deeper_levels(spark):
    depths = {}
    for r in QUERIES["crawl_budget"](spark, SF_DIR).collect():
        depths.setdefault(r.host, set()).add(r.depth)
    assert max(max(d) for d in depths.values()) >= 2
    free = {}
    for r in QUERIES["crawl_misses"](spark, SF_DIR).collect():
        free.setdefault(r.host, set()).add(r.depth)
    assert free


def test_a_table_may_be_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    folder, file = (sorted(map(tuple, QUERIES["rate_audit"](spark, d).collect())) for d in (str(tmp_path), SF_DIR))
    assert folder == file != []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["host", "n_pages", "n_documents", "n_hidden", "n_locale_urls"]
    assert df.count() > 0
