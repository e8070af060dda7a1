"""Exact percentiles per group from one distributed sort and counts per partition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_folder


def finite(c: str) -> F.Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def exact_percentiles(parts: DataFrame | Sequence[DataFrame], group: Sequence[str], value: str, row_id: str, probs: Sequence[float], partitions: int | None = None) -> DataFrame:
    """Percentiles ``probs`` of ``value`` per group, interpolated linearly at position ``p * (n - 1)``; the error is 0.

    ``parts`` may be one table or several (days, files) that are combined; a ``row_id`` delivered in more than one of them
    counts once. The rows are range-partitioned by (group, value, row_id), so a group of any size, and a value of any
    frequency, spreads over as many partitions as it needs. Each partition then counts its rows per group; running
    sums of these counts give each partition's offset in each group; the target positions fall into known partitions,
    at a known place, and just these rows are fetched. No group is ever gathered in one task.

    Null, NaN and infinite values and null ids are left out; null group columns form a group of their own. Groups without a finite
    value have no row; empty input gives an empty result. Other columns are ignored.
    Returns the group columns, ``n`` and one column ``q0``, ``q1``, ... per probability.
    """
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probabilities lie between 0 and 1")
    parts = [parts] if isinstance(parts, DataFrame) else list(parts)
    keys = [f"g{i}" for i in range(len(group))]
    rows = reduce(
        DataFrame.unionByName,
        [p.filter(finite(value) & F.col(row_id).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(group, keys)], F.col(value).cast("double").alias("v"), F.col(row_id).alias("id")) for p in parts],
    )
    spark = rows.sparkSession
    shared_folder(spark)
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    sort = [*keys, "v", "id"]
    # the range partitioning also clusters the rows by these columns: dropping copies needs no second shuffle
    ordered = rows.repartitionByRange(partitions, *sort).dropDuplicates(sort).sortWithinPartitions(*sort).select(*keys, "v")
    ordered = ordered.checkpoint()
    placed = ordered.select(*keys, "v", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at"))

    counts = placed.groupBy(*keys, "pid").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    w = Window.partitionBy(*keys).orderBy("pid")
    counts = counts.select(*keys, "c", "first", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))

    targets = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.floor(h)
        targets.append(F.struct(F.lit(i).alias("i"), F.lit(0).alias("side"), lo.alias("k"), (h - lo).alias("w")))
        targets.append(F.struct(F.lit(i).alias("i"), F.lit(1).alias("side"), F.least(lo + 1, F.col("n") - 1).alias("k"), (h - lo).alias("w")))
    wanted = (
        counts.select("*", F.explode(F.array(*targets)).alias("t"))
        .filter((F.col("t.k") < F.col("upto")) & (F.col("t.k") >= F.col("upto") - F.col("c")))
        .select(*keys, "n", F.col("t.i").alias("i"), F.col("t.side").alias("side"), F.col("t.w").alias("w"), (F.col("first") + F.col("t.k") - (F.col("upto") - F.col("c"))).alias("at"))
    )
    got = wanted.join(placed.select("at", "v"), "at")
    qs = []
    for i in range(len(probs)):
        low, high, w = (F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col(c))) for side, c in ((0, "v"), (1, "v"), (0, "w")))
        qs.append((low + (high - low) * w).alias(f"q{i}"))
    return got.groupBy(*keys).agg(F.max("n").alias("n"), *qs).select(*[F.col(k).alias(c) for c, k in zip(group, keys)], "n", *[f"q{i}" for i in range(len(probs))])
