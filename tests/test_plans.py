"""Shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

from sitelens.operators import crawl
from sitelens.plans import derived
from sitelens.plans.queries import QUERIES
from sitelens.session import LeveledTable, materialize_bucketed

SF_DIR = "/root/testdata/sf0.001"
# Queries that run jobs while they are built are covered by their lazy parts.
LAZY = sorted(
    set(QUERIES)
    - {"crawl_reachable", "crawl_budget", "crawl_misses", "requested_crawl", "site_report", "site_report_json", "report_roundtrip"}
    - {"site_documents", "site_documents_compact", "loaded_documents", "robots_admission"}
    - {name for name in QUERIES if name.startswith("stream")}
    - {"rate_audit"}
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairs_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInArrow"):
        assert node not in text
    assert text.count("ArrowEvalPython") <= 1


@pytest.mark.parametrize("name", LAZY)
def test_plain_markup_is_read_natively(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "parse_batch" not in text or "parse_batch(rest" in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(QUERIES["url_canonical"](spark, SF_DIR))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text
    text = plan(QUERIES["wordlist_entries"](spark, SF_DIR))
    assert "html" not in text.split("ReadSchema")[1]


def test_native_links_send_no_plain_text_to_python(spark):
    text = plan(QUERIES["internal_links"](spark, SF_DIR))
    node = text[text.index("ArrowEvalPython") :].splitlines()
    assert "parse_batch(rest" in node[0]
    # The projection below hands on no markup of plain pages.
    assert "if (isnull(native_hrefs" in node[1] and ", html#" not in node[1].split("Project")[1][:60]


def test_rounds_move_only_the_links_they_meet(spark):
    """Frontier, graph and visited keys are read in place, and a frontier is read in its own round only."""
    sites = derived.sites(spark, SF_DIR)
    graph = materialize_bucketed(
        crawl.link_graph(sites, derived.linked_pages(spark, SF_DIR), derived.robots(spark, SF_DIR)),
        "graph",
        ["site", "norm"],
    )
    visited = LeveledTable(spark, "visited", ["site", "norm"])
    for level in range(3):
        visited.append(crawl._seeds(sites).withColumn("norm", F.concat("norm", F.lit(str(level)))), level)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        round_ = crawl._candidates(visited.level(2).join(graph, ["site", "norm"]), visited.all().select("site", "norm"), 2)
        text = plan(round_)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        visited.close()
    # The one exchange is the met links', which the aggregation of targets needs anyway.
    assert text.count("Exchange") == 1 and text.count("Bucketed: true") == 3
    frontier = [line for line in text.splitlines() if "PartitionFilters" in line and "max_pages" in line]
    assert len(frontier) == 1 and "(level#" in frontier[0] and "= 2)" in frontier[0]


def test_a_report_parses_its_pages_once(spark):
    """What the report reads after its entries are written has no tokenizer and no markup."""
    text = plan(QUERIES["site_report"](spark, SF_DIR))
    assert "ArrowEvalPython" not in text and "html#" not in text


def test_outcomes_aggregate_before_the_shuffle(spark):
    text = plan(QUERIES["fetch_outcomes"](spark, SF_DIR))
    assert "partial_min" in text and "SortAggregate" not in text
