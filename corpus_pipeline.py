"""From raw documents to a training mix, one operator after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitelens.llm import jaccard, lines, mixing, neighbours, templates
from sitelens.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, learnt from ``labels``; further columns may have any name."""
    # Further columns go by their place meanwhile, apart from those that judging adds.
    aside = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(a) for c, a in aside.items()))
    kept = neighbours.toxicity(plain, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 0")
    return kept.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by three documents or more stay in the largest of them only."""
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles.

    That with the smallest id of a group stays. Documents without words or without id are
    no copies of each other and stay. Different texts under one id are documents of their
    own: those that are no copies of another stay, all of them; equal ones stay together.
    """
    named = docs.filter("doc_id IS NOT NULL")
    # Joined under a key of id and text, so that every class has a number of its own.
    key = F.xxhash64(docs["doc_id"], docs["text"])
    ids = named.select(key.alias("row"), F.col("doc_id").alias("id")).distinct()
    found = jaccard.linked(named.select(key.alias("doc_id"), "text"), n=5, percent=80)
    members = materialize(
        found.filter("n_shingles > 0").selectExpr("doc_id AS row", "component_id AS class").distinct().join(ids, "row"),
        "class-members",
    )
    first = members.groupBy("class").agg(F.min(F.struct("id", "row")).alias("kept"))
    copies = materialize(members.join(first, "class").filter("row <> kept.row").select("row"), "copies")
    return docs.join(copies, docs["doc_id"].isNotNull() & (key == copies["row"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text leaks no ``benchmark`` item."""
    return templates.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixed),
]

#: Nearest neighbours and hash permutations are beyond SQL; a test holds the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
