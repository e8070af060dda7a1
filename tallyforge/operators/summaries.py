"""One-row summaries of functions and types, per snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores as s


def _or0(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def function_summary(functions: DataFrame, group: Sequence[str] = (), macros: int = 0, exported: int = 0) -> DataFrame:
    """Counts, extremes and means of a ``functions`` table; all zero for an empty one (without groups)."""
    prod, test, pub = ~F.col("is_test"), F.col("is_test"), F.col("is_pub")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}")
    top = lambda c: _or0(F.max(c)).cast("bigint")
    n_prod, n_pub = F.count_if(prod), F.count_if(prod & pub)
    return functions.groupBy(*group).agg(
        F.count("*").alias("total_functions"),
        top("lines").alias("max_function_lines"),
        F.coalesce(F.avg("lines"), F.lit(0.0)).alias("mean_function_lines"),
        F.count_if(F.col("lines") > 70).alias("functions_over_70_lines"),
        top("nesting_depth").alias("max_nesting_depth"),
        mean("nesting_depth"),
        top("cyclomatic").alias("max_cyclomatic"),
        mean("cyclomatic"),
        top("params").alias("max_params"),
        _or0(F.sum("mutable_bindings")).alias("total_mutable_bindings"),
        F.count_if((F.col("lines") > 5) & (F.col("cyclomatic") > 1) & (F.col("assertions") < 2)).alias("functions_under_2_assertions"),
        F.coalesce(F.avg("assertions"), F.lit(0.0)).alias("mean_assertions_per_function"),
        F.coalesce(F.avg("meaningful_assertions"), F.lit(0.0)).alias("mean_meaningful_assertions_per_function"),
        s.guarded_ratio(_or0(F.sum(F.when(test, F.col("assertions")))), F.sum(F.when(prod, F.col("cyclomatic")))).alias("test_density"),
        n_prod.alias("production_function_count"),
        n_pub.alias("public_function_count"),
        s.overhead_ratio(n_prod, F.lit(macros), n_pub, F.lit(exported)).alias("function_overhead_ratio"),
        _or0(F.sum(F.when(prod, F.col("cyclomatic")))).alias("production_cyclomatic"),
        _or0(F.sum(F.when(prod, F.col("lines")))).alias("production_lines"),
    )


def type_summary(types: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return types.groupBy(*group).agg(
        F.count("*").alias("total_types"),
        _or0(F.sum("bool_fields")).alias("total_bool_fields"),
        _or0(F.sum("option_fields")).alias("total_option_fields"),
        F.greatest(F.coalesce(F.max("state_cardinality_log2"), F.lit(0.0)), F.lit(0.0)).alias("max_state_cardinality_log2"),
    )


def snapshot_summary(functions: DataFrame, types: DataFrame, duplication: DataFrame | None = None) -> DataFrame:
    """The one-row frames side by side."""
    out = function_summary(functions).crossJoin(F.broadcast(type_summary(types)))
    return out.crossJoin(F.broadcast(duplication.select("duplication_score"))) if duplication is not None else out.withColumn("duplication_score", F.lit(0.0))
