"""From a source tree to scores: the whole pipeline of one snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregates, cohorts, duplicates, entropy, summaries
from ..policy import Policy
from ..session import Scratch
from ..sources import rust
from . import corpus, dimensions


@dataclass
class Report:
    source: rust.Snapshot
    summary: DataFrame
    entropy_files: DataFrame
    entropy_total: DataFrame
    duplication: DataFrame
    scored: dimensions.Scored
    heatmap: DataFrame


def analyze(spark: SparkSession, path: str, policy: Policy = Policy(), semantic: dict[str, DataFrame] | None = None, saved: DataFrame | None = None) -> Report:
    """Parse, summarize, score and attribute one source tree. ``semantic`` (``sources.reports.read_semantic``) adds resolved
    cardinalities and call edges; without edges coupling scores 1 - density of ``saved`` (``coupling.density`` of an earlier
    run), else 1, and still enters the composite."""
    files = rust.read_files(spark, path)
    source = rust.snapshot(files)
    scratch = Scratch(spark)
    source.measured = scratch.save(source.measured)  # parsed once
    row = source.macros.first()
    macros, exported = int(row["macros"] or 0), int(row["exported"] or 0)
    fp = source.fingerprints.withColumn("fn_id", F.concat_ws("|", "name", "file", F.col("line").cast("string")))
    near = scratch.save(duplicates.near_pairs(fp))  # read by the score and by the details of the heatmap
    dup = duplicates.duplication_score(fp, pairs=near)
    if not row["files_analyzed"]:
        raise ValueError(f"no file under {path} could be parsed")
    summary = summaries.function_summary(source.functions, (), macros, exported).crossJoin(F.broadcast(summaries.type_summary(source.types))).crossJoin(F.broadcast(dup.select("duplication_score")))
    summary = summary.withColumn("production_lines", F.lit(int(row["production_lines"] or 0)).cast("bigint"))  # code lines of the sources, not of their functions
    counts = entropy.token_counts(files.join(source.files.filter("error is null").select("path"), "path", "left_semi"), ["path"], "content")
    sem = semantic or {}
    obs = dimensions.bloat(source.functions)
    obs = obs.unionByName(dimensions.state_types(source.types, resolved=sem.get("type_cardinalities")))
    obs = obs.unionByName(dimensions.state_functions(source.functions, resolved=sem.get("function_cardinalities")))
    obs = obs.unionByName(dimensions.economy(source.functions, macros=macros, exported=exported))
    if "call_edges" in sem:
        obs = obs.unionByName(dimensions.coupling_rows(sem["call_edges"]))
    stats = cohorts.cohort_stats(corpus.cohort_feed(source.functions, source.types, (), macros, exported), ["cohort"], "value")
    # read by every dimension, by the composite and by the heatmap
    obs = scratch.save(dimensions.score_observations(obs, policy, stats))
    one = spark.range(1).select()
    bare = None if "call_edges" in sem else dimensions.coupling_fallback(saved, one)
    scored = dimensions.score(obs, policy, one, dup, coupling=bare)
    scored.dimensions = scratch.save(scored.dimensions)  # five rows, read by the composite and once per dimension of the heatmap
    scored.composite = scored.dimensions.agg(aggregates.scalarize(F.col("score"), policy.objective_scalarization).alias("score"))
    duplicated = dimensions.duplication_rows(fp, duplicates.details(duplicates.exact_members(fp), near))
    heat = dimensions.heatmap(scored, policy, (), duplicated, dimensions.overhead_rows(source.functions, macros=source.macros))
    heat = scratch.save(heat)
    return Report(source, summary, entropy.entropy(counts, ["path"]), entropy.entropy(entropy.pooled(counts)), dup, scored, heat)
