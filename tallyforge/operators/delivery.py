"""Rows as they are delivered: once, and in a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row per key. Deliveries of a key carry the same content, so it does not matter which one stays.

    Select the needed columns first: this shuffles what it is given.
    """
    return df.dropDuplicates(list(key))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """``df`` with its position from 1 in ``order``, which should be total, without ever gathering the rows in one task.

    The rows are range-partitioned and sorted once and written with the number of their partition and their place in it; one row per
    partition then tells how many come before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = Scratch(df.sparkSession).save(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = sizes.select("_pid", "_first", (F.sum("_c").over(Window.orderBy("_pid")) - F.col("_c")).alias("_before"))
    out = placed.join(F.broadcast(before), "_pid")
    return out.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).select(*df.columns, name)
