"""Aggregations of item scores and losses: means that respect zeros, tail risk, weights by file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import EPSILON, clamp01, size_weight
from ..policy import Aggregation


def geometric_mean(s: Column) -> Column:
    """1 of nothing, 0 if any value is 0 (``ln(0)`` is NULL in Spark, so the guard is needed)."""
    return F.when(F.count(s) == 0, F.lit(1.0)).when(F.min(s) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(s > 0, s)))))


def arithmetic_mean(s: Column) -> Column:
    return F.coalesce(F.avg(s), F.lit(1.0))


def power_mean_score(s: Column, p: float) -> Column:
    p = max(p, 1.0)
    mean = F.avg(F.pow(1.0 - s, F.lit(p)))
    return F.coalesce(clamp01(1.0 - F.pow(mean, F.lit(1.0 / p))), F.lit(1.0))


def weighted_mean(v: Column, w: Column) -> Column:
    """Falls back to the plain mean when the weights vanish."""
    return F.when(F.sum(w) <= EPSILON, F.avg(v)).otherwise(F.sum(v * w) / F.sum(w))


def scalarize(s: Column, kind: str = "geometric_mean_score") -> Column:
    return geometric_mean(s) if kind == "geometric_mean_score" else arithmetic_mean(s)


def guarded_mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def count_if(c: Column) -> Column:
    return F.count_if(c)


def tail_size(n: Column, alpha: float) -> Column:
    """How many of ``n`` items are the worst ``alpha``: at least one."""
    a = min(max(alpha, EPSILON), 1.0)
    return F.least(F.greatest(F.ceil(n * F.lit(a)), F.lit(1)), n)


#: Losses are first counted in this many equal buckets; only the bucket that holds the tail's border is looked at by value.
TAIL_BUCKETS = 4096


def tail_sums(df: DataFrame, group: Sequence[str], score: str, alpha: float) -> DataFrame:
    """(group, n, k, loss, tail, border, next) with one row per group: number of items, size of the tail, sum of all losses, sum
    of the ``k`` greatest losses, the least loss inside the tail and the greatest loss outside (0 if there is none).

    A selection by buckets, not a sort: a group of any size is counted partially before the shuffle, only the losses of the bucket
    that holds the border are then grouped by value, and no window sees more rows than there are buckets, or distinct losses in one bucket.
    """
    keys = list(group)
    rows = df.select(*keys, (1.0 - F.col(score)).alias("_l")).withColumn("_b", F.least(F.greatest(F.floor(F.col("_l") * TAIL_BUCKETS), F.lit(0)), F.lit(TAIL_BUCKETS - 1)))
    hist = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.sum("_l").alias("_t"), F.max("_l").alias("_m"))
    w = Window.partitionBy(*keys)
    falling = w.orderBy(F.col("_b").desc())
    upto = falling.rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("n", F.sum("_c").over(w)).withColumn("loss", F.sum("_t").over(w)).withColumn("k", tail_size(F.col("n"), alpha))
    hist = hist.withColumn("_before", F.sum("_c").over(upto) - F.col("_c")).withColumn("_above", F.coalesce(F.sum("_t").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    hist = hist.withColumn("_below", F.coalesce(F.lead("_m").over(falling), F.lit(0.0)))
    at = hist.filter((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("_c"))).drop("_c", "_t", "_m")
    # only the rows of the bucket at the border are looked at by value
    held = [c for c in at.columns if c not in keys]
    levels = (rows.join(at, [*keys, "_b"]) if keys else rows.join(F.broadcast(at), "_b")).groupBy(*keys, *held, "_l").agg(F.count("*").alias("_c"))
    falling = Window.partitionBy(*keys).orderBy(F.col("_l").desc())
    past = falling.rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("_gone", F.coalesce(F.sum("_c").over(past), F.lit(0))).withColumn("_taken", F.coalesce(F.sum(F.col("_c") * F.col("_l")).over(past), F.lit(0.0)))
    levels = levels.withColumn("_lower", F.coalesce(F.lead("_l").over(falling), F.col("_below"))).withColumn("_need", F.col("k") - F.col("_before") - F.col("_gone"))
    border = levels.filter((F.col("_need") > 0) & (F.col("_need") <= F.col("_c")))
    return border.select(
        *keys, "n", "k", "loss", (F.col("_above") + F.col("_taken") + F.col("_need") * F.col("_l")).alias("tail"), F.col("_l").alias("border"), F.when(F.col("_need") < F.col("_c"), F.col("_l")).otherwise(F.col("_lower")).alias("next")
    )


def aggregate_scores(df: DataFrame, group: Sequence[str], policy: Aggregation, score: str = "score", file: str = "file", size: str = "size_hint") -> DataFrame:
    """(group, score): one score per group by the policy. Groups come from the rows, so no group is empty.

    Rows with a null score are left out. Every policy aggregates partially before its shuffle.
    """
    df = df.filter(F.col(score).isNotNull())
    s = F.col(score)
    if policy.kind == "geometric_mean_score":
        return df.groupBy(*group).agg(geometric_mean(s).alias("score"))
    if policy.kind == "arithmetic_mean_score":
        return df.groupBy(*group).agg(arithmetic_mean(s).alias("score"))
    if policy.kind == "power_mean_loss":
        return df.groupBy(*group).agg(power_mean_score(s, policy.p).alias("score"))
    if policy.kind == "mean_plus_cvar_loss":
        tail = tail_sums(df, group, score, policy.alpha)
        return tail.select(*group, clamp01(1.0 - (F.col("loss") / F.col("n") + policy.tail_weight * F.col("tail") / F.col("k"))).alias("score"))
    if policy.kind == "hierarchical_file_weighted_mean_loss":
        w = size_weight(F.col(size), policy.size_weighting)
        inner = df.groupBy(*group, file).agg(weighted_mean(1.0 - s, w).alias("_loss"), F.sum(F.greatest(F.col(size).cast("double"), F.lit(1.0))).alias("_size"))
        outer = size_weight(F.col("_size"), policy.size_weighting)
        return inner.groupBy(*group).agg(clamp01(1.0 - weighted_mean(F.col("_loss"), outer)).alias("score"))
    raise ValueError(f"unknown aggregation {policy.kind!r}")
