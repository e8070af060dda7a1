"""Cohort statistics, and thresholds derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores as s
from ..policy import Policy, Strategy
from ..session import Scratch


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def moments(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population deviation, least and greatest of the finite values; merges partially by itself."""
    v = F.col(value)
    return df.filter(finite(v)).groupBy(*group).agg(F.count("*").alias("value_count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("min_raw"), F.max(v).alias("max_raw"))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(group, q0, q1, ...): exact quantiles of the finite values, interpolated linearly, for groups of any size.

    Values are first counted, so a value of any frequency is one row; the distinct ones are range-partitioned by (group, value), and
    written with the number of their partition. Sums per partition, one row each, tell in which partition a position lies;
    only there places are counted out. No group is ever in one task or in one buffer. Null group columns are a group of their own.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    rows = df.filter(finite(F.col(value))).select(*[F.col(c).alias(k) for c, k in zip(group, keys)], F.col(value).cast("double").alias("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counted.repartitionByRange(parts, *keys, "_v").withColumn("_pid", F.spark_partition_id())
    placed = Scratch(df.sparkSession).save(placed)
    sums = placed.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("_n", F.sum("_s").over(w)).withColumn("_from", F.sum("_s").over(w.orderBy("_pid")) - F.col("_s"))
    at = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        at += [F.struct(F.lit(i).alias("i"), F.lit(False).alias("up"), F.floor(h).alias("k"), (h - F.floor(h)).alias("w")), F.struct(F.lit(i).alias("i"), F.lit(True).alias("up"), F.ceil(h).alias("k"), (h - F.floor(h)).alias("w"))]
    wanted = sums.select("*", F.explode(F.array(*at)).alias("t")).filter((F.col("t.k") >= F.col("_from")) & (F.col("t.k") < F.col("_from") + F.col("_s")))
    wanted = wanted.groupBy(*keys, "_pid").agg(F.first("_from").alias("_from"), F.collect_list("t").alias("_t"))  # at most two for each probability
    same = F.col("x._pid") == F.col("y._pid")
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    inside = placed.alias("x").join(wanted.alias("y"), same).select("x.*", "_from", "_t")
    upto = F.col("_from") + F.sum("_c").over(Window.partitionBy(*keys, "_pid").orderBy("_v"))
    hit = inside.withColumn("_upto", upto).select(*keys, "_v", "_c", "_upto", F.explode("_t").alias("t")).filter((F.col("t.k") < F.col("_upto")) & (F.col("t.k") >= F.col("_upto") - F.col("_c")))
    qs = []
    for i in range(len(probs)):
        low, high, share = (F.max(F.when((F.col("t.i") == i) & (F.col("t.up") == up), F.col(c))) for up, c in ((False, "_v"), (True, "_v"), (False, "t.w")))
        qs.append((low + (high - low) * share).alias(f"q{i}"))
    return hit.groupBy(*keys).agg(*qs).select(*[F.col(k).alias(c) for c, k in zip(group, keys)], *[f"q{i}" for i in range(len(probs))])


def cohort_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``moments`` and the exact quartiles, interpolated linearly. One row per group, written once: readers are many."""
    q = exact_quantiles(df, group, value, (0.25, 0.5, 0.75)).select(*[F.col(c).alias(f"_{c}") for c in group], F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    m = moments(df, group, value)
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return Scratch(df.sparkSession).save(m.join(q, same).drop(*[f"_{c}" for c in group]))


def merge_moments(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Combine tables of ``moments`` (of days, files, corpora) into one, as if taken over all values at once."""
    n, m, sd = F.col("value_count"), F.col("mean"), F.col("stddev")
    total = F.sum(n)
    mean = F.sum(n * m) / total
    squares = F.sum(n * (sd * sd + m * m)) / total
    return parts.filter(n > 0).groupBy(*group).agg(total.alias("value_count"), mean.alias("mean"), F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0))).alias("stddev"), F.min("min_raw").alias("min_raw"), F.max("max_raw").alias("max_raw"))


def strategy_threshold(strategy: Strategy, target: float) -> Column:
    """The threshold as a column over ``cohort_stats``; the target where the statistics are missing, too few or not usable."""
    k = strategy.kind
    if k == "use_target_threshold":
        return F.lit(target)
    if k == "scaled_target_threshold":
        return F.lit(target * strategy.multiplier)
    if k == "cohort_mean":
        found = F.col("mean") * strategy.multiplier
    elif k == "cohort_mean_stddev":
        found = F.col("mean") + F.col("stddev") * strategy.stddev_multiplier
    elif k == "cohort_upper_quartile":
        found = F.col("q75") * strategy.multiplier
    elif k == "cohort_median_iqr":
        found = F.col("q50") + s.robust_stddev(F.col("q25"), F.col("q75")) * strategy.iqr_multiplier
    else:
        raise ValueError(f"unknown strategy {k!r}")
    usable = (F.col("value_count") >= strategy.min_count) & s.valid_threshold(found)
    return F.when(F.coalesce(usable, F.lit(False)), found).otherwise(F.lit(target))


def normalize(df: DataFrame, stats: DataFrame | None, cohort: str, policy: Policy, on: Sequence[str] = (), raw: str = "raw") -> DataFrame:
    """``df`` with ``threshold`` and ``normalized`` for one cohort; ``stats`` has at most one row per ``on``."""
    strategy, target = policy.strategy(cohort), policy.directional.of(cohort)
    if stats is None or strategy.kind in ("use_target_threshold", "scaled_target_threshold"):
        out = df.withColumn("threshold", strategy_threshold(strategy, target) if stats is not None or "target" in strategy.kind else F.lit(target))
    else:
        held = stats.select(*on, strategy_threshold(strategy, target).alias("threshold"))
        joined = df.join(held, list(on), "left") if on else df.join(held, how="left")
        out = joined.withColumn("threshold", F.coalesce("threshold", F.lit(target)))
    return out.withColumn("normalized", s.ratio_normalize(F.col(raw), F.col("threshold")))
