"""Session settings and the shared scratch folder.

Lineage is cut by writing parquet tables, never by keeping blocks on executors:
a written table survives the loss of any executor, keeps column pruning, and
gives the optimizer a true size, so that a broadcast is only chosen for a side
that was measured to be small.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    """Settings every plan here relies on; all are runtime SQL settings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # Splits a hot host's partition of a join into advisory-size pieces.
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Streaming state on disk: seen sets and retry states outgrow a heap.
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    only made up for a local master, as in tests.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
    root = tempfile.mkdtemp(prefix="sitelens-")
    spark.conf.set(_CHECKPOINT_KEY, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/sitelens/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> str:
    """Write ``df`` once to the shared folder; returns its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, label))


def materialize_bucketed(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """As :func:`materialize`, hash-bucketed on ``keys``.

    Joins on exactly these keys then read the table in place; only the other
    side moves. ``df`` must come out of an aggregation by ``keys``: its shuffle
    partitions are then the buckets, and no second shuffle is needed.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"sitelens_{label}_{uuid.uuid4().hex}"
    (
        df.write.format("parquet")
        .option("path", scratch_path(spark, label))
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(table)
    )
    written = spark.table(table)
    # The files stay; only the name was needed, to carry the bucketing.
    spark.sql(f"DROP TABLE {table}")
    return written


class LeveledTable:
    """A table that grows by levels, hash-bucketed on ``keys`` like the table it is joined with.

    Each level is appended under its number, a file per bucket. A level is read alone by
    partition pruning, and all levels are read in place: joins on the keys move only the
    other side, however many levels there are.
    """

    def __init__(self, spark: SparkSession, label: str, keys: list[str]):
        self.spark, self.keys = spark, keys
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"sitelens_{label}_{uuid.uuid4().hex}"
        self.path = scratch_path(spark, label)

    def append(self, df: DataFrame, level: int) -> None:
        (
            df.withColumn("level", F.lit(level))
            .repartition(self.buckets, *self.keys)
            .write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .partitionBy("level")
            .bucketBy(self.buckets, *self.keys)
            .sortBy(*self.keys)
            .saveAsTable(self.name)
        )

    def all(self) -> DataFrame:
        return self.spark.table(self.name)

    def level(self, level: int) -> DataFrame:
        return self.all().filter(F.col("level") == level)

    def close(self) -> None:
        """Forget the name; what was read from the table must be written by then. The files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
