"""Positions inside groups without sorting a whole group in one task.

A plain ``row_number() over (partition by host)`` puts a hot host into one task.
Here a group is cut into buckets along its order, rows are numbered inside their
bucket, and bucket offsets come from a running sum over the small table of
bucket counts. The result is the exact position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sitelens.session import materialize


def number_by_key(
    df: DataFrame, group: list[str], key: str, out: str, bits: int = 16
) -> DataFrame:
    """1-based position of each row in its group by a unique, dense BIGINT ``key``.

    A bucket holds at most ``2**bits`` consecutive keys.
    """
    bucketed = df.withColumn("_bucket", F.expr(f"shiftright({key}, {bits})"))
    by_bucket = [*group, "_bucket"]
    before = (
        Window.partitionBy(*group)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bucketed.groupBy(*by_bucket)
        .count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = F.row_number().over(Window.partitionBy(*by_bucket).orderBy(key))
    return (
        bucketed.withColumn("_inside", inside)
        .join(offsets, by_bucket)
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )


def number_by_order(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """1-based position of each row in its group by any ``order`` columns.

    Rows are range-partitioned by group and order, so a hot group spans many
    partitions, then written once with their running number: the range cut must
    not change between the two readings below. Choosing the cut reads the rows too,
    so they are written before it instead of worked out twice.
    """
    df = materialize(df, "unranked")
    numbered = materialize(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id()),
        "ranked",
    )
    before = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        numbered.groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        numbered.join(offsets, [*group, "_part"])
        .withColumn(out, F.expr("_offset + _row - _first + 1"))
        .drop("_row", "_part", "_first", "_offset")
    )
