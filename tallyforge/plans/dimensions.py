"""The five dimensions: from items to observations, dimension scores, the composite and the heatmap.

Every frame may hold many snapshots: ``by`` names the columns that tell them apart (none for a single snapshot).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores as s
from ..operators import attribution, aggregates, cohorts, coupling, overlay
from ..policy import Policy

OBSERVED = ("dimension", "kind", "file", "line", "name", "detail", "cohort", "size_hint", "raw", "scope_path")


def _rows(df: DataFrame, by: Sequence[str], dimension: str, kind: str, cohort: str | None, size: Column, raw: Column, detail: Column, name: Column | None = None, file: Column | None = None) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *by,
        F.lit(dimension).alias("dimension"),
        F.lit(kind).alias("kind"),
        (file if file is not None else F.col("file").cast("string")).alias("file"),
        (F.col("line") if "line" in have else F.lit(0)).cast("bigint").alias("line"),
        (name if name is not None else F.col("name")).cast("string").alias("name"),
        detail.alias("detail"),
        F.lit(cohort).cast("string").alias("cohort"),
        size.cast("double").alias("size_hint"),
        raw.alias("raw"),
        (F.col("scope_path") if "scope_path" in have else F.array().cast("array<struct<kind:string,name:string>>")).alias("scope_path"),
    )


def bloat(functions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each function that is not a test."""
    return _rows(functions.filter(~F.col("is_test")), by, "bloat", "function", "bloat_function", F.col("lines"), s.bloat_raw("lines"), F.concat(F.col("lines").cast("string"), F.lit(" lines")))


def state_types(types: DataFrame, by: Sequence[str] = (), resolved: DataFrame | None = None) -> DataFrame:
    """One row per type; a resolved cardinality replaces the parsed one."""
    if resolved is not None:
        types = overlay.overlay_lookup(types, resolved, "cardinality_log2", default="state_cardinality_log2")
        bits = F.col("cardinality_log2")
    else:
        bits = F.col("state_cardinality_log2")
    return _rows(types, by, "state_cardinality", "type", "state_cardinality_type", F.col("total_fields"), s.state_raw(bits), F.concat(F.round(bits, 2).cast("string"), F.lit(" bits")))


def state_functions(functions: DataFrame, by: Sequence[str] = (), resolved: DataFrame | None = None) -> DataFrame:
    """Non-test functions with parsed state; the filter looks at the parsed value, then the resolved one replaces it."""
    own = "internal_state_cardinality_log2"
    rows = functions.filter(~F.col("is_test") & (F.col(own) > 0))
    if resolved is not None:
        rows = rows.withColumnRenamed(own, "parsed_log2")
        rows = overlay.overlay_lookup(rows, resolved, own, equal=("name", "line"), default="parsed_log2")
    return _rows(rows, by, "state_cardinality", "function", "state_cardinality_function", F.col("lines"), s.state_raw(own), F.concat(F.round(F.col(own), 2).cast("string"), F.lit(" bits")))


def economy(functions: DataFrame, by: Sequence[str] = (), macros: int = 0, exported: int = 0) -> DataFrame:
    """One row per snapshot: production over public surface. Without any public surface the score is 1, so raw is NULL."""
    prod, pub = F.count_if(~F.col("is_test")), F.count_if(~F.col("is_test") & F.col("is_pub"))
    ratio = s.overhead_ratio(prod, F.lit(macros), pub, F.lit(exported))
    one = functions.groupBy(*by).agg(ratio.alias("ratio"), (pub + exported).alias("surface"))
    return _rows(one, by, "code_economy", "codebase", "code_economy", F.lit(1.0), F.when(F.col("surface") > 0, s.economy_raw("ratio")), F.concat(F.round("ratio", 2).cast("string"), F.lit(" overhead")), F.lit("<codebase>"), F.lit("<codebase>"))


def coupling_rows(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per function or module with its outgoing cross-module edges, at its own file and line."""
    own = coupling.function_rows(edges, by)
    segment = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    scope = F.when(F.col("function").isNull(), F.array(segment("module", "module"))).otherwise(F.array(segment("module", "module"), segment("function", "function")))
    own = own.withColumn("scope_path", scope).withColumn("name", F.concat_ws("::", "module", "function"))
    rows = _rows(own, by, "coupling_density", "module", "coupling_module", F.lit(1.0), s.coupling_raw("outgoing"), F.concat(F.col("outgoing").cast("string"), F.lit(" outgoing cross-module edge(s)")))
    return rows.withColumn("kind", F.when(F.size("scope_path") > 1, F.lit("function")).otherwise(F.lit("module")))


def score_observations(rows: DataFrame, policy: Policy, stats: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """``rows`` with threshold, normalized and calibrated_score by the cohort's strategy and calibrator.

    Cohorts are few and known at plan time: their choices become one CASE over ``cohort``. ``stats`` (cohort statistics, one
    row per ``on`` and cohort) is joined only if a strategy asks for it.
    """
    from ..policy import COHORTS

    asked = [c for c in COHORTS if policy.strategy(c).kind.startswith("cohort_")]
    if stats is not None and asked:
        held = stats.select(*on, "cohort", *[c for c in ("value_count", "mean", "stddev", "q25", "q50", "q75") if c in stats.columns])
        rows = rows.join(held, [*on, "cohort"], "left")
    threshold = F.lit(None).cast("double")
    for c in reversed(COHORTS):
        st, target = policy.strategy(c), policy.directional.of(c)
        found = cohorts.strategy_threshold(st, target) if stats is not None or "target" in st.kind else F.lit(target)
        threshold = F.when(F.col("cohort") == c, found).otherwise(threshold)
    rows = rows.withColumn("threshold", threshold).withColumn("normalized", s.ratio_normalize(F.col("raw"), F.col("threshold")))
    score = F.lit(None).cast("double")
    for c in reversed(COHORTS):
        score = F.when(F.col("cohort") == c, policy.calibrator(c).score(F.col("normalized"))).otherwise(score)
    rows = rows.withColumn("calibrated_score", F.when(F.col("raw").isNull(), F.lit(1.0)).otherwise(score))
    return rows.drop("value_count", "mean", "stddev", "q25", "q50", "q75")


@dataclass
class Scored:
    observations: DataFrame
    dimensions: DataFrame  # (by, dimension, score, item_count)
    composite: DataFrame  # (by, score)


def dimension_scores(observations: DataFrame, policy: Policy, by: Sequence[str] = ()) -> DataFrame:
    """(by, dimension, score, item_count) of the dimensions that have observations."""
    counts = observations.groupBy(*by, "dimension").agg(F.count("*").alias("item_count"))
    parts = []
    for d in ("state_cardinality", "bloat", "coupling_density"):
        own = observations.filter(F.col("dimension") == d)
        parts.append(aggregates.aggregate_scores(own, [*by, "dimension"], policy.aggregation(d), score="calibrated_score"))
    parts.append(observations.filter(F.col("dimension") == "code_economy").select(*by, "dimension", F.col("calibrated_score").alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(counts, [*by, "dimension"])


def score(observations: DataFrame, policy: Policy, snapshots: DataFrame, duplication: DataFrame | None = None, by: Sequence[str] = (), coupling: DataFrame | None = None) -> Scored:
    """Dimension scores and the composite for every snapshot.

    ``snapshots`` has one row per snapshot (the ``by`` columns); ``duplication`` is ``duplicates.duplication_score``; ``coupling``
    (``coupling_fallback``) holds for snapshots without coupling observations. A dimension without observations scores 1 and
    still enters the composite.
    """
    from ..policy import DIMENSIONS

    found = dimension_scores(observations, policy, by)
    if duplication is not None:
        found = found.unionByName(duplication.select(*by, F.lit("duplication").alias("dimension"), (1.0 - F.col("duplication_score")).alias("score"), F.lit(0).cast("bigint").alias("item_count")))
    if coupling is not None:
        seen = observations.filter(F.col("dimension") == "coupling_density").select(*by)
        bare = coupling.join(seen, list(by) or F.lit(True), "left_anti")
        found = found.unionByName(bare.select(*by, "dimension", "score", F.lit(0).cast("bigint").alias("item_count")))
    grid = snapshots.select(*by, F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("dimension"))
    dims = grid.join(found, [*by, "dimension"], "left").select(*by, "dimension", F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("item_count", F.lit(0).cast("bigint")).alias("item_count"))
    comp = dims.groupBy(*by).agg(aggregates.scalarize(F.col("score"), policy.objective_scalarization).alias("score"))
    return Scored(observations, dims, comp)


def overhead_rows(functions: DataFrame, by: Sequence[str] = (), macros: DataFrame | None = None) -> DataFrame:
    """(by, file, line, name, detail, scope_path, units): each private function, and one row of so many units for all macros that
    are not exported. ``macros`` has (by, macros)."""
    scope = F.col("scope_path") if "scope_path" in functions.columns else F.array().cast("array<struct<kind:string,name:string>>")
    private = functions.filter(~F.col("is_test") & ~F.col("is_pub"))
    out = private.select(*by, "file", F.col("line").cast("bigint").alias("line"), "name", F.lit("non-pub overhead fn").alias("detail"), scope.alias("scope_path"), F.lit(1).cast("bigint").alias("units"))
    if macros is None:
        return out
    n = F.col("macros").cast("bigint")
    none = F.array().cast("array<struct<kind:string,name:string>>")
    return out.unionByName(macros.filter(n > 0).select(*by, F.lit("<codebase>").alias("file"), F.lit(0).cast("bigint").alias("line"), F.lit("<macro_rules>").alias("name"), F.concat(n.cast("string"), F.lit(" non-exported control-flow macro(s)")).alias("detail"), none.alias("scope_path"), n.alias("units")))


def heatmap(scored: Scored, policy: Policy, by: Sequence[str] = (), duplicated: DataFrame | None = None, overhead: DataFrame | None = None) -> DataFrame:
    """Responsibility of every lossy item in all five dimensions, on the composite of its snapshot.

    State, bloat and coupling are itemized; duplication is shared equally by the rows of ``duplicated`` (``duplication_rows``),
    economy by the units of ``overhead`` (``overhead_rows``); coupling that has a score but no edges is one ``<codebase>`` row.
    """
    kind = policy.objective_scalarization
    cols = (*by, "file", "line", "function_name", "dimension", "responsibility", "detail", "scope_path")

    def others(d: str) -> DataFrame:
        return attribution.composite_with(scored.dimensions.filter(F.col("dimension") != d), list(by), kind)

    def lossy(d: str) -> DataFrame:
        return scored.dimensions.filter((F.col("dimension") == d) & s.has_loss(F.col("score")))

    out = None
    for d in ("state_cardinality", "bloat", "coupling_density"):
        items = scored.observations.filter(F.col("dimension") == d)
        rows = attribution.itemized_heatmap(items, list(by), policy.aggregation(d), others(d), kind, score="calibrated_score")
        rows = rows.withColumnRenamed("name", "function_name").select(*cols)
        out = rows if out is None else out.unionByName(rows)
    if duplicated is not None:
        rows = attribution.equal_share_heatmap(duplicated.drop("dimension"), list(by), lossy("duplication").select(*by, "score"), others("duplication"), kind)
        out = out.unionByName(rows.withColumn("dimension", F.lit("duplication")).withColumnRenamed("name", "function_name").select(*cols))
    if overhead is not None:
        rows = attribution.equal_share_heatmap(overhead, list(by), lossy("code_economy").select(*by, "score"), others("code_economy"), kind, "units", s.LOSS_TOLERANCE)
        out = out.unionByName(rows.withColumn("dimension", F.lit("code_economy")).withColumnRenamed("name", "function_name").select(*cols))
    bare = lossy("coupling_density").filter(F.col("item_count") == 0).select(*by, "score")
    rows = attribution.whole_share(bare, others("coupling_density"), "coupling_density", list(by), kind)
    held = bare.withColumnRenamed("score", "_score")
    rows = rows.join(held, list(by)) if by else rows.crossJoin(F.broadcast(held))
    rows = rows.withColumn("function_name", F.lit("coupling_density")).withColumn("detail", F.format_string("density %.4f (from saved semantic summary)", 1.0 - F.col("_score"))).withColumn("scope_path", F.array().cast("array<struct<kind:string,name:string>>"))
    return out.unionByName(rows.select(*cols))


def duplication_rows(functions: DataFrame, details: DataFrame, member: str = "fn_id", by: Sequence[str] = ()) -> DataFrame:
    """One row of score 0 for each duplicated function (``duplicates.details``); the dimension's score stays global."""
    own = functions.join(details, [*by, member]).dropDuplicates([*by, member])
    return _rows(own, by, "duplication", "function", None, F.lit(1.0), F.lit(1.0), F.col("detail")).withColumn("calibrated_score", F.lit(0.0))


def coupling_fallback(saved: DataFrame | None, snapshots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, dimension, score) without call edges: 1 - saved density, and 1 where nothing was saved."""
    rows = snapshots.select(*by)
    if saved is not None:
        rows = rows.join(saved, list(by), "left") if by else rows.crossJoin(F.broadcast(saved))
    else:
        rows = rows.withColumn("density", F.lit(None).cast("double"))
    return rows.select(*by, F.lit("coupling_density").alias("dimension"), s.clamp01(1.0 - F.coalesce("density", F.lit(0.0))).alias("score"))
