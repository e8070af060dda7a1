"""Scoring many snapshots against statistics of all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scores as s
from ..operators import aggregates, attribution, cohorts, duplicates
from ..policy import Policy
from ..session import Scratch
from . import dimensions


def cohort_feed(functions: DataFrame, types: DataFrame | None, by: Sequence[str] = (), macros: int = 0, exported: int = 0) -> DataFrame:
    """(by, cohort, value): what each cohort's statistics are taken over, as the scored engine takes them: lines, 1 + log2 of
    cardinalities, and the overhead ratio with its macros and exports where there is any public surface; nothing for coupling."""
    prod = ~F.col("is_test")
    out = functions.filter(prod).select(*by, F.lit("bloat_function").alias("cohort"), F.col("lines").cast("double").alias("value"))
    own = F.col("internal_state_cardinality_log2")
    out = out.unionByName(functions.filter(prod & (own > 0)).select(*by, F.lit("state_cardinality_function").alias("cohort"), (1.0 + own).alias("value")))
    n, p = F.count_if(prod), F.count_if(prod & F.col("is_pub"))
    ratio = functions.groupBy(*by).agg(s.overhead_ratio(n, F.lit(macros), p, F.lit(exported)).alias("value"), (p + exported).alias("surface")).filter("surface > 0")
    out = out.unionByName(ratio.select(*by, F.lit("code_economy").alias("cohort"), F.col("value").cast("double").alias("value")))
    if types is not None:
        out = out.unionByName(types.select(*by, F.lit("state_cardinality_type").alias("cohort"), (1.0 + F.col("state_cardinality_log2")).alias("value")))
    return out


def run(
    observations: DataFrame,
    feed: DataFrame,
    policy: Policy,
    label: str = "label",
    top: int | None = 10,
    fingerprints: DataFrame | None = None,
    edges: DataFrame | None = None,
    overhead: DataFrame | None = None,
    saved: DataFrame | None = None,
) -> tuple[dimensions.Scored, DataFrame]:
    """Scores of every label in all five dimensions against statistics shared by all, and the ``top`` heatmap rows of each label (all without ``top``).

    ``fingerprints`` (label, fn_id, name, file, line, shape) and ``edges`` (label and call edges) give duplication and coupling,
    both measured inside of each label; ``observations`` holds coupling rows only where ``edges`` is not given. ``overhead`` is
    ``dimensions.overhead_rows``; ``saved`` (label, density) holds for labels without edges.
    """
    by = [label]
    scratch = Scratch(observations.sparkSession)
    stats = cohorts.cohort_stats(feed, ["cohort"], "value")
    labels = observations.select(label)
    if edges is not None:
        own = dimensions.coupling_rows(edges, by)
        observations = observations.unionByName(own.select(*observations.columns))
        labels = labels.unionByName(edges.select(label))
    duplication = duplicated = None
    if fingerprints is not None:
        labels = labels.unionByName(fingerprints.select(label))
        pairs = scratch.save(duplicates.near_pairs(fingerprints, by=by))
        duplication = duplicates.duplication_score(fingerprints, pairs=pairs, by=by)
        duplicated = dimensions.duplication_rows(fingerprints, duplicates.details(duplicates.exact_members(fingerprints, by=by), pairs, by=by), by=by)
    # read by every dimension, by the composite and by the heatmap
    obs = scratch.save(dimensions.score_observations(observations, policy, stats))
    snapshots = scratch.save(labels.distinct())
    bare = None if saved is None else dimensions.coupling_fallback(saved, snapshots, by)
    scored = dimensions.score(obs, policy, snapshots, duplication, by, bare)
    scored.dimensions = scratch.save(scored.dimensions)  # five rows a label, read by the composite and once per dimension of the heatmap
    scored.composite = scored.dimensions.groupBy(*by).agg(aggregates.scalarize(F.col("score"), policy.objective_scalarization).alias("score"))
    heat = dimensions.heatmap(scored, policy, by, duplicated, overhead)
    return scored, heat if top is None else attribution.top_per_label(heat, label, top)
