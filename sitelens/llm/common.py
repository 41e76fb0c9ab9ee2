"""What the training-data operators share: words, bounded samples, session settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitelens.session import tune

# A word is a run of anything but space and the five ASCII controls
# from tab to carriage return; sources are compared on these words.
BLANK = " \t\n\x0b\x0c\r"
_BLANKS = r"[\x20\x09-\x0D]+"

#: Size of an Arrow batch: long texts make one large, so it is bounded in bytes.
BATCH_BYTES = "4m"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the operators that hand whole texts to Python."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def words(text: Column | str) -> Column:
    """Words of a text in order, natively; none for null."""
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _BLANKS), "")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fixed split into learnt and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % n


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y``: one row per labelled document, the majority where it has several labels."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    )


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, the same on each run: those whose keys hash lowest."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)).limit(bound)
