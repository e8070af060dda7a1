"""Differences of two snapshots: summaries, heatmaps, dimensions, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores as s

#: The compared metrics; those in HIGHER are better when larger, all others when smaller.
METRICS = (
    "max_function_lines",
    "mean_function_lines",
    "functions_over_70_lines",
    "max_nesting_depth",
    "mean_nesting_depth",
    "max_cyclomatic",
    "mean_cyclomatic",
    "max_params",
    "total_mutable_bindings",
    "total_bool_fields",
    "total_option_fields",
    "max_state_cardinality_log2",
    "functions_under_2_assertions",
    "mean_assertions_per_function",
    "mean_meaningful_assertions_per_function",
    "test_density",
    "duplication_score",
    "function_overhead_ratio",
)
HIGHER = ("mean_assertions_per_function", "mean_meaningful_assertions_per_function", "test_density")
#: The metrics of the raw vector.
RAW_VECTOR = (
    "duplication_score",
    "function_overhead_ratio",
    "functions_over_70_lines",
    "max_cyclomatic",
    "max_function_lines",
    "max_nesting_depth",
    "max_state_cardinality_log2",
    "mean_assertions_per_function",
    "mean_cyclomatic",
    "mean_function_lines",
    "total_bool_fields",
    "total_mutable_bindings",
)


def melt(summary: DataFrame, group: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(group, metric, value) of a wide summary."""
    there = [m for m in metrics if m in summary.columns]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in there])
    return summary.select(*group, F.explode(pairs).alias("x")).select(*group, "x.metric", "x.value")


def raw_vector(summary: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return melt(summary, group, [*RAW_VECTOR, "coupling_density"])


def diff_summaries(before: DataFrame, after: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(metric, before, after, delta, assessment); ``coupling_density`` takes part if either side has it, a missing side being 0."""
    metrics = [*METRICS, *(["coupling_density"] if "coupling_density" in {*before.columns, *after.columns} else [])]
    fill = lambda df: df if "coupling_density" in df.columns or len(metrics) == len(METRICS) else df.withColumn("coupling_density", F.lit(0.0))
    one, two = melt(fill(before), group, metrics).withColumnRenamed("value", "before"), melt(fill(after), group, metrics).withColumnRenamed("value", "after")
    out = one.join(two, [*group, "metric"]).withColumn("delta", F.col("after") - F.col("before"))
    return out.withColumn("assessment", s.assess_delta(F.col("delta"), F.col("metric").isin(*HIGHER)))


def delta_vector(diff: DataFrame) -> DataFrame:
    """Deltas turned so that positive is always worse."""
    return diff.withColumn("delta", F.when(F.col("metric").isin(*HIGHER), -F.col("delta")).otherwise(F.col("delta"))).select("metric", "delta")


def assessment_counts(diff: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    c = lambda a: F.count_if(F.col("assessment") == a).alias(a)
    return diff.groupBy(*group).agg(c("improved"), c("regressed"), c("unchanged"))


def keep_last(df: DataFrame, on: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the last in ``order``; an argmax, so it merges before the shuffle."""
    rest = [c for c in df.columns if c not in on]
    return df.groupBy(*on).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*on, *[F.col(f"_r.{c}").alias(c) for c in rest])


def diff_heatmaps(before: DataFrame, after: DataFrame, on: Sequence[str] = ("file", "function_name", "dimension"), value: str = "responsibility") -> DataFrame:
    """(on, before, after, delta, status): appeared, disappeared, or improved / regressed / unchanged.

    A key that occurs several times counts with its last row in heatmap order, which is the one of least value.
    """
    least = lambda df, n: df.groupBy(*on).agg(F.min(value).alias(n))
    out = least(before, "before").join(least(after, "after"), list(on), "full")
    out = out.withColumn("delta", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    return out.withColumn("status", F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "disappeared").otherwise(s.assess_loss_delta(F.col("delta"))))


def status_counts(diff: DataFrame) -> DataFrame:
    names = ("appeared", "disappeared", "improved", "regressed", "unchanged")
    return diff.agg(*[F.count_if(F.col("status") == n).alias(n) for n in names])


def diff_dimensions(before: DataFrame, after: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(dimension, before, after, delta, assessment) of losses; inputs have (group, dimension, score)."""
    one = before.select(*group, "dimension", (1.0 - F.col("score")).alias("before"))
    two = after.select(*group, "dimension", (1.0 - F.col("score")).alias("after"))
    out = one.join(two, [*group, "dimension"]).withColumn("delta", F.col("after") - F.col("before"))
    return out.withColumn("assessment", s.assess_loss_delta(F.col("delta")))


def strict_loss_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """after - before by dimension; a dimension that only one side has is an error that names it."""
    one, two = before.select("dimension", F.col("score").alias("b")), after.select("dimension", F.col("score").alias("a"))
    both = one.join(two, "dimension", "full")
    missing = F.raise_error(F.concat(F.lit("dimension only on one side: "), F.col("dimension"))).cast("double")
    return both.select("dimension", F.when(F.col("a").isNull() | F.col("b").isNull(), missing).otherwise(F.col("b") - F.col("a")).alias("delta"))


def loss_vector(dimensions: DataFrame, composite: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, name, loss): the dimensions and the composite."""
    return dimensions.select(*group, F.col("dimension").alias("name"), (1.0 - F.col("score")).alias("loss")).unionByName(composite.select(*group, F.lit("composite").alias("name"), (1.0 - F.col("score")).alias("loss")))
