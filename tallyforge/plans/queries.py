"""The driver's queries for the core operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import color, scores as s, text
from ..operators import aggregates, attribution, cohorts, coupling, diffs, duplicates, entropy, frames, matching, overlay, rollup, sketch, summaries
from ..operators.delivery import once
from ..policy import Aggregation, Policy, Strategy
from ..sources import rust
from ..streaming import debounce
from . import corpus as corpora, dimensions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


def rr(c: str, n: int) -> F.Column:
    """Rounded, with exact ties moved off the border so that the order of a sum's terms can't decide."""
    return (F.round(F.col(c) + F.lit(1e-9), n) + F.lit(0.0)).alias(c)


def r6(c) -> F.Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(c if isinstance(c, str) else "x")


# ---- functions: lineitem rows stand for functions, suppliers for files ----


def functions(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("s"), "l_suppkey").alias("file"),
        F.concat(F.lit("f"), "l_partkey").alias("name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        F.col("l_quantity").cast("bigint").alias("lines"),
        F.col("l_linenumber").cast("bigint").alias("cyclomatic"),
        (F.col("l_linenumber") % 4).cast("bigint").alias("nesting_depth"),
        (F.col("l_partkey") % 6).alias("params"),
        (F.col("l_partkey") % 3).alias("mutable_bindings"),
        (F.col("l_orderkey") % 4).alias("assertions"),
        (F.col("l_orderkey") % 3).alias("meaningful_assertions"),
        (F.col("l_partkey") % 5).cast("double").alias("internal_state_cardinality_log2"),
        (F.col("l_returnflag") == "R").alias("is_test"),
        (F.col("l_linestatus") == "O").alias("is_pub"),
        "l_orderkey",
    )


FN = """fn AS (SELECT 's' || l_suppkey AS file, 'f' || l_partkey AS name, l_orderkey * 10 + l_linenumber AS line, CAST(l_quantity AS BIGINT) AS lines,
  CAST(l_linenumber AS BIGINT) AS cyclomatic, CAST(l_linenumber % 4 AS BIGINT) AS nesting_depth, l_partkey % 6 AS params, l_partkey % 3 AS mutable_bindings,
  l_orderkey % 4 AS assertions, l_orderkey % 3 AS meaningful_assertions, CAST(l_partkey % 5 AS DOUBLE) AS bits,
  l_returnflag = 'R' AS is_test, l_linestatus = 'O' AS is_pub, l_orderkey FROM lineitem)"""
OBS = (
    FN
    + """, o AS (SELECT file, line, name, lines, log2(greatest(CAST(lines AS DOUBLE), 1.0)) AS raw FROM fn WHERE NOT is_test),
ob AS (SELECT *, raw / log2(45.0) AS normalized, exp(-ln(2.0) * pow(raw / log2(45.0), 3)) AS score FROM o)"""
)


def bloat_scored(spark: SparkSession, d: str) -> DataFrame:
    rows = dimensions.score_observations(dimensions.bloat(functions(spark, d)), Policy())
    return rows.withColumn("score", F.col("calibrated_score"))


@query(f"WITH {OBS} SELECT file, round(CASE WHEN min(score) <= 0 THEN 0.0 ELSE exp(avg(ln(score))) END, 6) AS score FROM ob GROUP BY file")
def q_bloat_score(spark, d):
    return aggregates.aggregate_scores(bloat_scored(spark, d), ["file"], Aggregation()).select("file", r6("score"))


@query(f"WITH {OBS} SELECT file, line, name, lines || ' lines' AS detail, 'bloat_function' AS cohort, CAST(lines AS DOUBLE) AS size_hint, round(raw, 6) AS raw, round(normalized, 6) AS normalized, round(score, 6) AS calibrated_score FROM ob")
def q_bloat_observations(spark, d):
    return bloat_scored(spark, d).select("file", "line", "name", "detail", "cohort", "size_hint", r6("raw"), r6("normalized"), r6("calibrated_score"))


@query(
    """WITH n AS (SELECT l_orderkey, l_quantity / 10.0 AS n FROM lineitem)
SELECT l_orderkey, round(CASE WHEN n <= 1 THEN 1.0 ELSE 1.0 / n END, 6) AS reciprocal, round(exp(-ln(2.0) * n / 2.0), 6) AS exponential,
round(CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.0, 1.0 - (n - 1.0) / 3.0) END, 6) AS linear, round(exp(-ln(2.0) * pow(n / 2.0, 2)), 6) AS stretched,
n > 1 AS over FROM n"""
)
def q_calibrators(spark, d):
    n = F.col("l_quantity") / 10.0
    rows = _t(spark, d, "lineitem").select(
        "l_orderkey", s.capped_reciprocal(n).alias("reciprocal"), s.exponential_decay(n, 2.0).alias("exponential"), s.linear_decay(n, 4.0).alias("linear"), s.stretched_decay(n, 2.0, 2.0).alias("stretched"), s.exceeds_target(n).alias("over")
    )
    return rows.select("l_orderkey", *[r6(c) for c in ("reciprocal", "exponential", "linear", "stretched")], "over")


# ---- aggregations per order status, over all bloat scores ----


def _by_status(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    raw = s.bloat_raw("l_quantity")
    score = Policy().calibrator("bloat_function").score(s.ratio_normalize(raw, F.lit(Policy().directional.bloat_log2_lines)))
    return li.select("l_linestatus", F.col("l_suppkey").alias("file"), F.col("l_quantity").alias("size_hint"), score.alias("score"))


BS = "b AS (SELECT l_linestatus, l_suppkey AS file, l_quantity AS size, 1 - exp(-ln(2.0) * pow(log2(greatest(l_quantity, 1.0)) / log2(45.0), 3)) AS l FROM lineitem)"


def _agg(policy: Aggregation):
    return lambda spark, d: aggregates.aggregate_scores(_by_status(spark, d), ["l_linestatus"], policy).select("l_linestatus", r6("score"))


query(f"WITH {BS} SELECT l_linestatus, round(avg(1 - l), 6) AS score FROM b GROUP BY l_linestatus", "q_agg_arithmetic")(_agg(Aggregation("arithmetic_mean_score")))
query(f"WITH {BS} SELECT l_linestatus, round(1 - pow(avg(pow(l, 3)), 1.0 / 3), 6) AS score FROM b GROUP BY l_linestatus", "q_agg_power")(_agg(Aggregation("power_mean_loss", p=3.0)))
query(
    f"""WITH {BS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l DESC) AS k, count(*) OVER (PARTITION BY l_linestatus) AS n FROM b)
SELECT l_linestatus, round(greatest(0.0, 1 - (avg(l) + 0.5 * avg(CASE WHEN k <= ceil(n * CAST(0.1 AS DOUBLE)) THEN l END))), 6) AS score FROM r GROUP BY l_linestatus""",
    "q_agg_mean_cvar",
)(_agg(Aggregation("mean_plus_cvar_loss", alpha=0.1, tail_weight=0.5)))
_WEIGHTS = {"uniform": "1.0", "linear": "greatest({x}, 1.0)", "sqrt": "sqrt(greatest({x}, 1.0))", "log2": "greatest(log2(greatest({x}, 1.0)), 1.0)"}
for _k, _w in _WEIGHTS.items():
    query(
        f"""WITH {BS}, i AS (SELECT l_linestatus, file, sum(l * {_w.format(x="size")}) / sum({_w.format(x="size")}) AS l, sum(greatest(size, 1.0)) AS size FROM b GROUP BY 1, 2)
SELECT l_linestatus, round(1 - sum(l * {_w.format(x="size")}) / sum({_w.format(x="size")}), 6) AS score FROM i GROUP BY 1""",
        f"q_agg_hierarchical_{_k}",
    )(_agg(Aggregation("hierarchical_file_weighted_mean_loss", size_weighting=_k)))


# ---- types: a user's distinct event types stand for bool fields ----


def user_types(spark, d) -> DataFrame:
    e = _t(spark, d, "events").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count("*").alias("bool_fields"))
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("name"), F.lit("users").alias("file"), F.col("user_id").alias("line"), "bool_fields", F.lit(0).cast("bigint").alias("option_fields"), F.col("bool_fields").alias("total_fields"), F.col("bool_fields").cast("double").alias("state_cardinality_log2")
    )


TY = "ty AS (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY user_id)"


@query(f"WITH {TY} SELECT 'u' || user_id AS name, CAST(k AS DOUBLE) AS raw, round(exp(-ln(2.0) * pow(k / 4.0, 2)), 6) AS calibrated_score FROM ty")
def q_state_types(spark, d):
    return dimensions.score_observations(dimensions.state_types(user_types(spark, d)), Policy()).select("name", "raw", r6("calibrated_score"))


@query(f"WITH {TY} SELECT count(*) AS total_types, CAST(sum(k) AS BIGINT) AS total_bool_fields, CAST(0 AS BIGINT) AS total_option_fields, CAST(max(k) AS DOUBLE) AS max_state_cardinality_log2 FROM ty")
def q_type_summary(spark, d):
    return summaries.type_summary(user_types(spark, d))


@query(f"WITH {FN} SELECT file, line, name, bits AS raw, round(exp(-ln(2.0) * pow(bits / 4.0, 2)), 6) AS calibrated_score FROM fn WHERE NOT is_test AND bits > 0")
def q_state_functions(spark, d):
    return dimensions.score_observations(dimensions.state_functions(functions(spark, d)), Policy()).select("file", "line", "name", "raw", r6("calibrated_score"))


@query(
    f"""WITH {FN}, c AS (SELECT file, count(*) FILTER (NOT is_test) AS n, count(*) FILTER (NOT is_test AND is_pub) AS p FROM fn GROUP BY file)
SELECT file, CASE WHEN p > 0 THEN round(log2(greatest(n / p, 1.0)), 6) END AS raw, CASE WHEN p > 0 THEN round(exp(-ln(2.0) * log2(greatest(n / p, 1.0)) / log2(5.0)), 6) ELSE 1.0 END AS calibrated_score FROM c"""
)
def q_code_economy(spark, d):
    rows = dimensions.economy(functions(spark, d).withColumnRenamed("file", "source"), ["source"])
    return dimensions.score_observations(rows, Policy()).select(F.col("source").alias("file"), r6("raw"), r6("calibrated_score"))


_SUMMARY = """count(*) AS total_functions, max(lines) AS max_function_lines, round(avg(lines), 6) AS mean_function_lines, count(*) FILTER (lines > 70) AS functions_over_70_lines,
max(nesting_depth) AS max_nesting_depth, round(avg(nesting_depth), 6) AS mean_nesting_depth, max(cyclomatic) AS max_cyclomatic, round(avg(cyclomatic), 6) AS mean_cyclomatic,
max(params) AS max_params, CAST(sum(mutable_bindings) AS BIGINT) AS total_mutable_bindings, count(*) FILTER (lines > 5 AND cyclomatic > 1 AND assertions < 2) AS functions_under_2_assertions,
round(avg(assertions), 6) AS mean_assertions_per_function, round(avg(meaningful_assertions), 6) AS mean_meaningful_assertions_per_function,
round(coalesce(sum(assertions) FILTER (is_test) / nullif(sum(cyclomatic) FILTER (NOT is_test), 0), 0.0), 6) AS test_density,
count(*) FILTER (NOT is_test) AS production_function_count, count(*) FILTER (NOT is_test AND is_pub) AS public_function_count,
round(coalesce(count(*) FILTER (NOT is_test) / nullif(count(*) FILTER (NOT is_test AND is_pub), 0), 0.0), 6) AS function_overhead_ratio,
CAST(sum(cyclomatic) FILTER (NOT is_test) AS BIGINT) AS production_cyclomatic, CAST(sum(lines) FILTER (NOT is_test) AS BIGINT) AS production_lines"""


_RAW_SUMMARY = re.sub(r"round\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*), 6\)", r"\1", _SUMMARY)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(f"WITH {FN} SELECT {_SUMMARY} FROM fn")
def q_summary(spark, d):
    return _rounded(summaries.function_summary(functions(spark, d)))


@query(f"WITH {FN} SELECT file, {_SUMMARY} FROM fn GROUP BY file")
def q_summary_by_file(spark, d):
    return _rounded(summaries.function_summary(functions(spark, d), ["file"]))


# ---- cohorts ----


def observations(spark, d) -> DataFrame:
    cols = ("obs_id", "label", "dimension", "kind", "file", "line", "name", "cohort", "size_hint", "raw", "normalized", "calibrated_score", "scope_path", "detail")
    return once(_t(spark, d, "observations").select(*cols), "obs_id")


OB1 = "ob1 AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY ingested_at) = 1)"
def f32(c: str) -> F.Column:
    """In single precision, so that the order of a sum's terms can't decide."""
    return F.col(c).cast("float").cast("double").alias(c)


_ST = f"""st AS (SELECT cohort, count(*) AS value_count, avg(raw) AS mean, stddev_pop(raw) AS stddev, min(raw) AS min_raw, max(raw) AS max_raw,
quantile_cont(raw, 0.25) AS q25, quantile_cont(raw, 0.5) AS q50, quantile_cont(raw, 0.75) AS q75 FROM ob1 WHERE isfinite(raw) GROUP BY cohort)"""


@query(f"WITH {OB1}, {_ST} SELECT cohort, value_count, CAST(CAST(mean AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(stddev AS FLOAT) AS DOUBLE) AS stddev, CAST(CAST(min_raw AS FLOAT) AS DOUBLE) AS min_raw, CAST(CAST(max_raw AS FLOAT) AS DOUBLE) AS max_raw, CAST(CAST(q25 AS FLOAT) AS DOUBLE) AS q25, CAST(CAST(q50 AS FLOAT) AS DOUBLE) AS q50, CAST(CAST(q75 AS FLOAT) AS DOUBLE) AS q75 FROM st")
def q_cohort_stats(spark, d):
    st = cohorts.cohort_stats(observations(spark, d), ["cohort"], "raw")
    return st.select("cohort", "value_count", *[f32(c) for c in ("mean", "stddev", "min_raw", "max_raw", "q25", "q50", "q75")])


@query(f"WITH {OB1}, {_ST} SELECT cohort, value_count, CAST(CAST(mean AS FLOAT) AS DOUBLE) AS mean, CAST(CAST(stddev AS FLOAT) AS DOUBLE) AS stddev, CAST(CAST(min_raw AS FLOAT) AS DOUBLE) AS min_raw, CAST(CAST(max_raw AS FLOAT) AS DOUBLE) AS max_raw FROM st")
def q_moments_merge(spark, d):
    """Moments of each month, combined: the same as over all rows."""
    obs = once(_t(spark, d, "observations").select("obs_id", "cohort", "raw", F.trunc("run_at", "month").alias("month")), "obs_id")
    merged = cohorts.merge_moments(cohorts.moments(obs, ["month", "cohort"], "raw"), ["cohort"])
    return merged.select("cohort", "value_count", *[f32(c) for c in ("mean", "stddev", "min_raw", "max_raw")])


@query()
def q_sketch_quartiles(spark, d):
    """Quartiles per label and cohort from mergeable sketches of each month."""
    obs = once(_t(spark, d, "observations").select("obs_id", "label", "cohort", "raw", F.trunc("run_at", "month").alias("month")), "obs_id")
    monthly = sketch.sketches(obs, ["month", "label", "cohort"], "raw")
    whole = sketch.merged(monthly.drop("month"), ["label", "cohort"])
    return sketch.quantiles(whole, ["label", "cohort"], [0.25, 0.5, 0.75])


def _norm(strategy: Strategy, sql: str, name: str) -> None:
    full = f"""WITH {OB1}, {_ST}, th AS (SELECT *, {sql} AS t FROM st WHERE cohort = 'bloat_function'),
u AS (SELECT CASE WHEN value_count >= {strategy.min_count} AND t > 1e-15 THEN t ELSE log2(45.0) END AS t FROM th)
SELECT obs_id, CAST(CAST(raw / t AS FLOAT) AS DOUBLE) AS normalized FROM ob1, u WHERE cohort = 'bloat_function' AND isfinite(raw)"""

    def run(spark, d):
        obs = observations(spark, d).filter(cohorts.finite(F.col("raw")) & (F.col("cohort") == "bloat_function"))
        st = cohorts.cohort_stats(obs, ["cohort"], "raw")
        out = cohorts.normalize(obs, st, "bloat_function", Policy(normalization={"bloat_function": strategy}), ["cohort"])
        return out.select("obs_id", f32("normalized"))

    query(full, name)(run)


_norm(Strategy("use_target_threshold"), "log2(45.0)", "q_norm_target")
_norm(Strategy("scaled_target_threshold", multiplier=2.0), "2 * log2(45.0)", "q_norm_scaled")
_norm(Strategy("cohort_mean", multiplier=1.5), "mean * 1.5", "q_norm_mean")
_norm(Strategy("cohort_mean_stddev", stddev_multiplier=2.0), "mean + stddev * 2.0", "q_norm_mean_sd")
_norm(Strategy("cohort_upper_quartile"), "q75", "q_norm_q75")
_norm(Strategy("cohort_median_iqr", iqr_multiplier=1.0), "q50 + (q75 - q25) / 1.349", "q_norm_median_iqr")
_norm(Strategy("cohort_mean", min_count=1_000_000_000), "mean", "q_norm_fallback")


_TARGETS = {"code_economy": "log2(5.0)", "state_cardinality_type": "4.0", "state_cardinality_function": "4.0", "bloat_function": "log2(45.0)", "coupling_module": "3.0"}


def _norm_all(strategy: Strategy, sql: str, name: str) -> None:
    """A strategy over all five cohorts, through the scorer of the plans; in ``sql`` g is the cohort's target."""
    full = f"""WITH {OB1}, {_ST}, tg AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {x})" for c, x in _TARGETS.items())}) v(cohort, g)),
u AS (SELECT cohort, g, CASE WHEN value_count >= {strategy.min_count} AND t > 1e-15 THEN t ELSE g END AS t FROM (SELECT cohort, g, value_count, {sql} AS t FROM st JOIN tg USING (cohort))),
n AS (SELECT obs_id, cohort, raw / t AS n FROM ob1 JOIN u USING (cohort) WHERE isfinite(raw))
SELECT obs_id, cohort, CAST(CAST(n AS FLOAT) AS DOUBLE) AS normalized,
round(exp(-ln(2.0) * pow(greatest(n, 0.0), CASE WHEN cohort = 'bloat_function' THEN 3 WHEN cohort LIKE 'state_cardinality%' THEN 2 ELSE 1 END)), 6) AS calibrated_score FROM n"""

    def run(spark, d):
        obs = observations(spark, d).filter(cohorts.finite(F.col("raw")) & F.col("cohort").isin(*_TARGETS)).select("obs_id", "cohort", "raw")
        st = cohorts.cohort_stats(obs, ["cohort"], "raw")
        out = dimensions.score_observations(obs, Policy(normalization={c: strategy for c in _TARGETS}), st)
        return out.select("obs_id", "cohort", f32("normalized"), r6("calibrated_score"))

    query(full, name)(run)


_norm_all(Strategy("use_target_threshold"), "g", "q_norm_all_target")
_norm_all(Strategy("scaled_target_threshold", multiplier=2.0), "2 * g", "q_norm_all_scaled")
_norm_all(Strategy("cohort_mean", multiplier=1.5), "mean * 1.5", "q_norm_all_mean")
_norm_all(Strategy("cohort_mean_stddev", stddev_multiplier=2.0), "mean + stddev * 2.0", "q_norm_all_mean_sd")
_norm_all(Strategy("cohort_upper_quartile"), "q75", "q_norm_all_q75")
_norm_all(Strategy("cohort_median_iqr", iqr_multiplier=1.0), "q50 + (q75 - q25) / 1.349", "q_norm_all_median_iqr")
_norm_all(Strategy("cohort_mean", min_count=1_000_000_000), "mean", "q_norm_all_fallback")


# ---- dimensions, composite and corpus: order priorities stand for corpus members ----


def corpus(spark, d) -> DataFrame:
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return functions(spark, d).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


CO = FN + ", co AS (SELECT fn.*, o_orderpriority AS label FROM fn JOIN orders ON l_orderkey = o_orderkey)"
DIMS = (
    CO
    + """, sc AS (SELECT label, 'bloat' AS dimension, exp(-ln(2.0) * pow(log2(greatest(CAST(lines AS DOUBLE), 1.0)) / log2(45.0), 3)) AS s FROM co WHERE NOT is_test
  UNION ALL SELECT label, 'state_cardinality', exp(-ln(2.0) * pow(bits / 4.0, 2)) FROM co WHERE NOT is_test AND bits > 0),
g AS (SELECT label, dimension, exp(avg(ln(s))) AS score, count(*) AS item_count FROM sc GROUP BY 1, 2),
e AS (SELECT label, 'code_economy' AS dimension, exp(-ln(2.0) * log2(greatest(count(*) FILTER (NOT is_test) / count(*) FILTER (NOT is_test AND is_pub), 1.0)) / log2(5.0)) AS score, CAST(1 AS BIGINT) AS item_count FROM co GROUP BY 1),
z AS (SELECT DISTINCT label, unnest(['duplication', 'coupling_density']) AS dimension, 1.0 AS score, CAST(0 AS BIGINT) AS item_count FROM co),
dm AS (SELECT * FROM g UNION ALL SELECT * FROM e UNION ALL SELECT * FROM z)"""
)


def scored_corpus(spark, d, policy: Policy = Policy()) -> dimensions.Scored:
    fn = corpus(spark, d)
    obs = dimensions.bloat(fn, ["label"]).unionByName(dimensions.state_functions(fn, ["label"])).unionByName(dimensions.economy(fn, ["label"]))
    return dimensions.score(dimensions.score_observations(obs, policy), policy, fn.select("label").distinct(), by=["label"])


@query(f"WITH {DIMS} SELECT label, dimension, round(score, 6) AS score, item_count FROM dm")
def q_corpus_dimensions(spark, d):
    return scored_corpus(spark, d).dimensions.select("label", "dimension", r6("score"), "item_count")


@query(f"WITH {DIMS} SELECT label, round(exp(avg(ln(score))), 6) AS score FROM dm GROUP BY label")
def q_composite(spark, d):
    return scored_corpus(spark, d).composite.select("label", r6("score"))


@query(f"WITH {DIMS} SELECT label, dimension AS name, round(1 - score, 6) AS loss FROM dm UNION ALL SELECT label, 'composite', round(1 - exp(avg(ln(score))), 6) FROM dm GROUP BY label")
def q_loss_vector(spark, d):
    sc = scored_corpus(spark, d)
    return diffs.loss_vector(sc.dimensions, sc.composite, ["label"]).select("label", "name", r6("loss"))


@query(
    f"""WITH {DIMS}, p AS (SELECT label, exp(avg(ln(score))) AS c, sum(ln(score)) FILTER (dimension <> 'bloat') AS rest, max(score) FILTER (dimension = 'bloat') AS b FROM dm GROUP BY label),
i AS (SELECT label, file, line, name, exp(-ln(2.0) * pow(log2(greatest(CAST(lines AS DOUBLE), 1.0)) / log2(45.0), 3)) AS s FROM co WHERE NOT is_test),
w AS (SELECT *, sum(ln(s)) OVER (PARTITION BY label) AS t, count(*) OVER (PARTITION BY label) AS n FROM i)
SELECT label, file, line, name AS function_name, round(exp((rest + (t - ln(s)) / n) / 5) - c, 9) AS responsibility FROM w JOIN p USING (label) WHERE s < 1 - 1e-12"""
)
def q_heatmap_corpus(spark, d):
    sc = scored_corpus(spark, d)
    rest = attribution.composite_with(sc.dimensions.filter("dimension <> 'bloat'"), ["label"])
    heat = attribution.itemized_heatmap(sc.observations.filter("dimension = 'bloat'"), ["label"], Aggregation(), rest, score="calibrated_score")
    return heat.select("label", "file", "line", F.col("name").alias("function_name"), (F.round("responsibility", 9) + F.lit(0.0)).alias("responsibility"))


# ---- attribution: the same items under each aggregation, per supplier ----


def _items(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem")
    score = Policy().calibrator("bloat_function").score(s.ratio_normalize(s.bloat_raw("l_quantity"), F.lit(Policy().directional.bloat_log2_lines)))
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("file"), F.col("l_quantity").alias("size_hint"), score.alias("score"))


IT = """it AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag AS file, l_quantity AS size,
exp(-ln(2.0) * pow(log2(greatest(l_quantity, 1.0)) / log2(45.0), 3)) AS s FROM lineitem), a AS (SELECT *, 1 - s AS l, count(*) OVER w AS n FROM it WINDOW w AS (PARTITION BY l_suppkey))"""


def _heat(policy: Aggregation, sql: str, name: str) -> None:
    def run(spark, d):
        heat = attribution.itemized_heatmap(_items(spark, d), ["l_suppkey"], policy)
        return heat.select("l_suppkey", "l_orderkey", "l_linenumber", (F.round("responsibility", 7) + F.lit(0.0)).alias("responsibility"))

    query(f"WITH {IT}, {sql} SELECT l_suppkey, l_orderkey, l_linenumber, round(r, 7) AS responsibility FROM x WHERE s < 1 - 1e-12 AND r >= 1e-12", name)(run)


_heat(Aggregation(), "x AS (SELECT *, exp((sum(ln(s)) OVER (PARTITION BY l_suppkey) - ln(s)) / n) - exp(avg(ln(s)) OVER (PARTITION BY l_suppkey)) AS r FROM a)", "q_heatmap_geo")
_heat(Aggregation("arithmetic_mean_score"), "x AS (SELECT *, (1 - s) / n AS r FROM a)", "q_heatmap_arith")
_heat(
    Aggregation("power_mean_loss", p=2.0),
    "x AS (SELECT *, sqrt(sum(l * l) OVER (PARTITION BY l_suppkey) / n) - sqrt(greatest(sum(l * l) OVER (PARTITION BY l_suppkey) - l * l, 0.0) / n) AS r FROM a)",
    "q_heatmap_power",
)
_heat(
    Aggregation("mean_plus_cvar_loss", alpha=0.1, tail_weight=0.5),
    """k AS (SELECT *, CAST(ceil(n * CAST(0.1 AS DOUBLE)) AS BIGINT) AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l DESC) AS rk FROM a),
t AS (SELECT l_suppkey, sum(l) AS s0, sum(CASE WHEN rk <= k THEN l ELSE 0 END) AS t0, coalesce(max(CASE WHEN rk = k + 1 THEN l END), 0) AS nx, max(k) AS k0, max(n) AS n0 FROM k GROUP BY 1),
x AS (SELECT k.*, greatest(0, 1 - ((s0 - l) / n0 + 0.5 * CASE WHEN rk <= k THEN (t0 - l + nx) / k0 ELSE t0 / k0 END)) - greatest(0, 1 - (s0 / n0 + 0.5 * t0 / k0)) AS r FROM k JOIN t USING (l_suppkey))""",
    "q_heatmap_cvar",
)
_heat(
    Aggregation("hierarchical_file_weighted_mean_loss", size_weighting="sqrt"),
    """f AS (SELECT l_suppkey, file, sum(sqrt(size)) AS fw, sum(size) AS sz FROM it GROUP BY 1, 2), g AS (SELECT l_suppkey, sum(sqrt(sz)) AS al FROM f GROUP BY 1),
x AS (SELECT a.*, sqrt(sz) / al * sqrt(size) * l / fw AS r FROM a JOIN f USING (l_suppkey, file) JOIN g USING (l_suppkey))""",
    "q_heatmap_hier",
)


@query(
    f"""WITH {DIMS}, p AS (SELECT label, exp(sum(ln(score)) FILTER (dimension <> 'code_economy') / 5) - exp(avg(ln(score))) AS gain FROM dm GROUP BY label),
v AS (SELECT label, file, line, name FROM co WHERE NOT is_test AND NOT is_pub), n AS (SELECT label, count(*) AS n FROM v GROUP BY label)
SELECT label, file, line, name AS function_name, round(gain / n, 9) AS responsibility FROM v JOIN p USING (label) JOIN n USING (label)"""
)
def q_heatmap_economy(spark, d):
    sc = scored_corpus(spark, d)
    rest = attribution.composite_with(sc.dimensions.filter("dimension <> 'code_economy'"), ["label"])
    own = sc.dimensions.filter("dimension = 'code_economy'").select("label", "score")
    private = corpus(spark, d).filter("not is_test and not is_pub").select("label", "file", "line", F.col("name").alias("function_name"))
    return attribution.equal_share_heatmap(private, ["label"], own, rest).withColumn("responsibility", F.round("responsibility", 9) + F.lit(0.0))


# ---- heatmap rows as they are stored ----


def hotspots(spark, d) -> DataFrame:
    rows = _t(spark, d, "hotspots").select("hotspot_id", "label", "file", "line", "function_name", "dimension", "responsibility", "run_at")
    return once(rows.filter("file is not null and dimension is not null and responsibility is not null and not isnan(responsibility)"), "hotspot_id")


HS = """hs AS (SELECT DISTINCT hotspot_id, label, file, line, function_name, dimension, responsibility, run_at FROM hotspots
WHERE file IS NOT NULL AND dimension IS NOT NULL AND responsibility IS NOT NULL AND NOT isnan(responsibility))"""
_ORD = "responsibility DESC, dimension, file, line, function_name"


@query(f"WITH {HS} SELECT file, line, function_name, dimension, responsibility FROM hs ORDER BY {_ORD} LIMIT 100")
def q_heatmap_topn(spark, d):
    return hotspots(spark, d).orderBy(*attribution.heatmap_order()).limit(100).select("file", "line", "function_name", "dimension", "responsibility")


@query(f"WITH {HS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_ORD}) AS position FROM hs) SELECT label, file, line, function_name, dimension, responsibility, position FROM r WHERE position <= 10")
def q_heatmap_topn_label(spark, d):
    return attribution.top_per_label(hotspots(spark, d), "label", 10).select("label", "file", "line", "function_name", "dimension", "responsibility", "position")


@query(f"WITH {HS} SELECT label, dimension, round(sum(responsibility) + 1e-9, 5) AS total, count(*) AS entries FROM hs GROUP BY 1, 2")
def q_heatmap_totals(spark, d):
    return attribution.dimension_totals(hotspots(spark, d), ["label"]).withColumn("total", rr("total", 5))


# ---- trees over scope paths ----


def _entries(spark, d) -> DataFrame:
    return observations(spark, d).select("scope_path", F.col("name").alias("function_name"), (1.0 - F.col("calibrated_score")).alias("responsibility"), "dimension", "file", "line").filter("responsibility is not null and not isnan(responsibility)")


EN = (
    OB1
    + """, en AS (SELECT CASE WHEN len(scope_path) > 0 THEN scope_path ELSE [{'kind': 'function', 'name': name}] END AS p, name AS function_name, 1 - calibrated_score AS r, dimension, file, line FROM ob1 WHERE calibrated_score IS NOT NULL AND NOT isnan(calibrated_score)),
px AS (SELECT p, k, array_to_string([x.kind || ':' || x.name for x in p[1:k]], '/') AS key, function_name, r, dimension, file, line FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM en))"""
)
_DIMS = ["bloat", "code_economy", "coupling_density", "duplication", "state_cardinality"]


@query(f"WITH {EN} SELECT key, k AS depth, any_value(p[k].name) AS name, round(sum(r) + 1e-9, 5) AS responsibility, count(*) AS entries FROM px GROUP BY key, k")
def q_rollup_tree(spark, d):
    return rollup.rollup_tree(_entries(spark, d)).select(rollup.key(F.col("path")).alias("key"), "depth", "name", rr("responsibility", 5), "entries")


@query(f"WITH {EN} SELECT key, " + ", ".join(f"round(coalesce(sum(r) FILTER (dimension = '{x}'), 0.0) + 1e-9, 5) AS {x}" for x in _DIMS) + " FROM px GROUP BY key")
def q_flame_amounts(spark, d):
    return rollup.dimension_amounts(rollup.rollup_tree(_entries(spark, d)), _DIMS).select(rollup.key(F.col("path")).alias("key"), *[rr(x, 5) for x in _DIMS])


@query(f"WITH {EN}, b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r DESC, file, line, dimension, function_name) AS n FROM px) SELECT key, file, line, dimension, function_name, r AS responsibility FROM b WHERE n = 1")
def q_hottest(spark, d):
    rows = _entries(spark, d).filter("file is not null and line is not null and dimension is not null")
    return rollup.hottest(rows).select(rollup.key(F.col("path")).alias("key"), "file", "line", "dimension", "function_name", "responsibility")


SQL["q_hottest"] = SQL["q_hottest"].replace("FROM px)", "FROM px WHERE file IS NOT NULL AND line IS NOT NULL AND dimension IS NOT NULL)")


@query(f"WITH {EN}, t AS (SELECT key, k, count(*) AS c FROM px GROUP BY key, k) SELECT CAST(sum(c) AS BIGINT) AS entries, 'all' AS name, CAST(0 AS BIGINT) AS depth FROM t WHERE k = 1 HAVING count(*) > 1 UNION ALL SELECT c, regexp_extract(key, '[^:/]*$'), k FROM t")
def q_tree_with_root(spark, d):
    return rollup.with_root(rollup.rollup_tree(_entries(spark, d))).select("entries", "name", "depth")


@query(
    f"""WITH {HS}, t AS (SELECT label, dimension, sum(round(responsibility * 1e6)) AS a FROM hs GROUP BY 1, 2), q AS (SELECT *, a * 40.0 / sum(a) OVER (PARTITION BY label) AS q FROM t),
f AS (SELECT *, floor(q) AS f, 40 - sum(floor(q)) OVER (PARTITION BY label) AS miss FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(q - f, 9) DESC, dimension) AS n FROM f WHERE a > 0)
SELECT label, dimension, CAST(f + CASE WHEN n <= miss THEN 1 ELSE 0 END AS BIGINT) AS cells FROM r"""
)
def q_apportion(spark, d):
    totals = hotspots(spark, d).groupBy("label", "dimension").agg(F.sum(F.round(F.col("responsibility") * 1e6)).alias("a")).filter("a > 0")
    return rollup.apportion(totals, ["label"], "a", 40, ["dimension"]).select("label", "dimension", "cells")


@query(
    """WITH t AS (SELECT r_name, n_name, c_mktsegment AS g, sum(o_totalprice) AS a FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, g))
SELECT r_name, n_name, g AS segment, round(a, 2) AS amount FROM t"""
)
def q_region_rollup(spark, d):
    """The trie rollup over a fixed hierarchy, with its grand total."""
    o, c, n, r = (_t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    seg = lambda c: F.struct(F.lit("module").alias("kind"), F.col(c).alias("name"))
    rows = rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.sum("o_totalprice").alias("responsibility"))
    tree = rollup.with_root(rollup.rollup_tree(rows.select(F.array(seg("r_name"), seg("n_name"), seg("c_mktsegment")).alias("scope_path"), F.lit("x").alias("function_name"), "responsibility", F.lit("d").alias("dimension"))))
    return tree.select(F.get("path", F.lit(0))["name"].alias("r_name"), F.get("path", F.lit(1))["name"].alias("n_name"), F.get("path", F.lit(2))["name"].alias("segment"), F.round("responsibility", 2).alias("amount"))


def _nation_tree(spark, d) -> DataFrame:
    c, n, r = (_t(spark, d, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    seg = lambda c: F.struct(F.lit("module").alias("kind"), F.col(c).alias("name"))
    return rollup.rollup_tree(rows.select(F.array(seg("r_name"), seg("n_name")).alias("scope_path"), F.lit("x").alias("function_name"), F.lit(1.0).alias("responsibility"), F.lit("d").alias("dimension")))


NT = """nt AS (SELECT r_name, n_name, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
rt AS (SELECT r_name, sum(c) AS c FROM nt GROUP BY 1), ro AS (SELECT *, row_number() OVER (ORDER BY c DESC, r_name) AS k FROM rt),
no AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY c DESC, n_name) AS j FROM nt)"""


@query(f"WITH {NT} SELECT 'module:' || r_name AS key, CAST(k AS VARCHAR) AS ids FROM ro UNION ALL SELECT 'module:' || r_name || '/module:' || n_name, k || '.' || j FROM no JOIN ro USING (r_name)")
def q_tree_pre_order(spark, d):
    return rollup.pre_order(_nation_tree(spark, d)).select(rollup.key(F.col("path")).alias("key"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ".").alias("ids"))


@query(f"WITH {NT} SELECT 'module:' || r_name AS key FROM rt UNION ALL SELECT 'module:' || r_name || '/module:' || n_name FROM nt WHERE r_name IN ('ASIA', 'EUROPE')")
def q_tree_visible(spark, d):
    return rollup.visible(_nation_tree(spark, d), ["module:ASIA", "module:EUROPE"]).select(rollup.key(F.col("path")).alias("key"))


@query(
    f"""WITH {NT}, tgt AS (SELECT r_name, n_name, k, j FROM no JOIN ro USING (r_name) ORDER BY r_name, n_name LIMIT 1)
SELECT 'module:' || ro.r_name AS key, CASE WHEN ro.r_name = t.r_name THEN 'direct' ELSE 'on_route' END AS relation FROM ro, tgt t WHERE ro.k <= t.k
UNION ALL SELECT 'module:' || no.r_name || '/module:' || no.n_name, 'on_route' FROM no, tgt t WHERE no.r_name = t.r_name AND no.j < t.j"""
)
def q_path_relations(spark, d):
    tree = _nation_tree(spark, d)
    target = tree.filter("depth = 2").select(rollup.key(F.col("path")).alias("k")).orderBy("k").first()["k"]
    return rollup.path_relations(tree, target).select(rollup.key(F.col("path")).alias("key"), "relation")


# ---- text ----

_TOK = "[(){}\\[\\]<>;:,.=+*/&|!?@#-]|[^(){}\\[\\]<>;:,.=+*/&|!?@#\\t\\n\\x{0b}\\x{0c}\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}-]+"
TK = f"""dc AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
tk AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOK}')) AS t FROM dc) GROUP BY 1, 2)"""


def docs(spark, d) -> DataFrame:
    return once(_t(spark, d, "documents").select("doc_id", "text").filter("text is not null"), "doc_id")


@query(f"WITH {TK} SELECT t AS token, CAST(sum(c) AS BIGINT) AS count FROM tk GROUP BY t")
def q_tokens(spark, d):
    return entropy.pooled(entropy.token_counts(docs(spark, d), ["doc_id"]))


_ENT = "CAST(sum(c) AS BIGINT) AS total, count(*) AS vocabulary, round(CASE WHEN count(*) > 1 THEN log2(sum(c)) - sum(c * log2(c)) / sum(c) ELSE 0.0 END, 6) AS entropy, round(CASE WHEN count(*) > 1 THEN (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)) ELSE 0.0 END, 6) AS normalized"


@query(f"WITH {TK} SELECT doc_id, {_ENT} FROM tk GROUP BY doc_id")
def q_entropy_doc(spark, d):
    return entropy.entropy(entropy.token_counts(docs(spark, d), ["doc_id"]), ["doc_id"]).select("doc_id", "total", "vocabulary", r6("entropy"), r6("normalized"))


@query(f"WITH {TK}, p AS (SELECT t, sum(c) AS c FROM tk GROUP BY t) SELECT {_ENT} FROM p")
def q_entropy_total(spark, d):
    return entropy.entropy(entropy.pooled(entropy.token_counts(docs(spark, d), ["doc_id"]))).select("total", "vocabulary", r6("entropy"), r6("normalized"))


@query()
def q_code_lines(spark, d):
    return docs(spark, d).select("doc_id", text.code_lines(F.col("text")).alias("code_lines"))


@query(
    f"WITH {OB1} SELECT obs_id, array_to_string([x.name for x in scope_path if x.kind = 'module'], '::') AS module_path, array_to_string([CASE x.kind WHEN 'module' THEN 'mod ' WHEN 'type' THEN 'type ' ELSE 'fn ' END || x.name for x in scope_path], ' > ') AS shown FROM ob1"
)
def q_scope_display(spark, d):
    return observations(spark, d).select("obs_id", text.module_path(F.col("scope_path")).alias("module_path"), F.array_join(F.transform("scope_path", text.scope_label), " > ").alias("shown"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 10 THEN p_name ELSE left(p_name, 9) || '…' END AS short, left(p_name, 6) AS clipped, p_size || 's' AS took FROM part WHERE p_size < 60")
def q_ellipsize(spark, d):
    return _t(spark, d, "part").filter("p_size < 60").select("p_partkey", text.ellipsize(F.col("p_name"), 10).alias("short"), text.clip(F.col("p_name"), 6).alias("clipped"), text.compact_duration(F.col("p_size")).alias("took"))


@query(
    """WITH e AS (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN '~' || (s // 3600) || ':' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE '~' || (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock,
CASE WHEN s < 60 THEN s || 's' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS compact FROM e"""
)
def q_duration(spark, d):
    sec = F.floor(F.abs("value") * 100)
    return _t(spark, d, "events").select("event_id", text.clock(sec).alias("clock"), text.compact_duration(sec).alias("compact"))


@query()
def q_rust_functions(spark, d):
    """Functions found in the documents that are Rust source as a whole."""
    rows = once(_t(spark, d, "documents").select("doc_id", "text", "source").filter("text is not null"), "doc_id").filter("lower(trim(source)) = 'source_listings'")
    found = rust.snapshot(rows.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))).functions
    return found.select("file", "name", "line", "lines", "params", "nesting_depth", "cyclomatic", "mutable_bindings", "assertions", "is_pub")


# ---- duplicates ----


def fingerprints(spark, d) -> DataFrame:
    return once(_t(spark, d, "fingerprints").select("fn_id", "shape"), "fn_id")


FP = "fp AS (SELECT fn_id, any_value(shape) AS s FROM fingerprints GROUP BY fn_id), lf AS (SELECT fn_id, s, len(s) AS n FROM fp WHERE len(s) >= 5)"
ND = (
    FP
    + """, ex AS (SELECT s, n, count(*) AS c, min(fn_id) AS f FROM lf GROUP BY s, n HAVING count(*) > 1), si AS (SELECT * FROM lf WHERE s NOT IN (SELECT s FROM ex)),
g AS (SELECT DISTINCT fn_id, n, s[k] || '/' || s[k + 1] || '/' || s[k + 2] AS r FROM (SELECT *, unnest(range(1, n - 1)) AS k FROM si)), gn AS (SELECT fn_id, count(*) AS m FROM g GROUP BY 1),
oo AS (SELECT x.fn_id AS a, y.fn_id AS b, count(*) AS o FROM g x JOIN g y ON x.r = y.r AND x.fn_id < y.fn_id AND least(x.n, y.n) >= 0.5 * greatest(x.n, y.n) GROUP BY 1, 2),
np AS (SELECT a, b, CAST(o AS DOUBLE) / (x.m + y.m - o) AS sim FROM oo JOIN gn x ON x.fn_id = a JOIN gn y ON y.fn_id = b WHERE CAST(o AS DOUBLE) / (x.m + y.m - o) > 0.8)"""
)


@query(f"WITH {ND} SELECT n AS shape_length, c AS members, f AS first FROM ex")
def q_exact_dups(spark, d):
    return duplicates.exact_groups(fingerprints(spark, d))


@query(f"WITH {ND} SELECT a, b, round(sim, 6) AS similarity FROM np")
def q_near_dups(spark, d):
    return duplicates.near_pairs(fingerprints(spark, d)).select("a", "b", r6("similarity"))


@query(
    f"""WITH {ND}, t AS (SELECT count(*) AS fingerprinted FROM fp), e AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS exact FROM ex), m AS (SELECT count(*) AS near FROM (SELECT a FROM np UNION SELECT b FROM np))
SELECT fingerprinted, exact, near, round((exact + near) / fingerprinted, 6) AS duplication_score FROM t, e, m"""
)
def q_dup_score(spark, d):
    return duplicates.duplication_score(fingerprints(spark, d)).select("fingerprinted", "exact", "near", r6("duplication_score"))


# ---- coupling: orders are calls from the customer's nation to the supplier's ----


def edges(spark, d, *by: str) -> DataFrame:
    li, o, c, n, su = (_t(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "supplier"))
    names = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("m"))
    caller = c.join(names, c.c_nationkey == names.k).select("c_custkey", F.col("m").alias("caller_module"), F.col("c_mktsegment").alias("caller_function"))
    callee = su.join(names, su.s_nationkey == names.k).select("s_suppkey", F.col("m").alias("callee_module"))
    calls = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey", *by), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey", *by).distinct()
    out = calls.join(caller, F.col("o_custkey") == F.col("c_custkey")).join(callee, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select(*by, "caller_module", "callee_module", "caller_function", F.concat(F.lit("c"), "o_custkey").alias("caller_file"), F.concat(F.lit("s"), "l_suppkey").alias("callee_file"), (F.col("o_custkey") * 100_000 + F.col("l_suppkey")).alias("caller_line"))


ED = """ed AS (SELECT DISTINCT a.n_name AS caller_module, b.n_name AS callee_module, c_mktsegment AS caller_function, 'c' || o_custkey AS caller_file, 's' || l_suppkey AS callee_file, o_custkey * 100000 + l_suppkey AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey),
de AS (SELECT DISTINCT caller_module AS x, callee_module AS y FROM ed WHERE caller_module <> callee_module), mo AS (SELECT x AS module FROM de UNION SELECT y FROM de)"""


@query(f"WITH {ED} SELECT (SELECT count(*) FROM mo) AS modules, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM mo) * ((SELECT count(*) FROM mo) - 1)), 6) AS density FROM de")
def q_coupling(spark, d):
    return coupling.density(edges(spark, d)).select("modules", "edges", r6("density"))


@query(f"WITH {ED} SELECT module, count(y) AS outgoing FROM mo LEFT JOIN de ON module = x GROUP BY module")
def q_coupling_modules(spark, d):
    return coupling.by_module(edges(spark, d))


@query(
    f"""WITH {ED}, f AS (SELECT caller_module AS module, caller_module || '::' || caller_function AS name, count(DISTINCT callee_module) AS outgoing FROM ed WHERE caller_module <> callee_module GROUP BY 1, 2)
SELECT * FROM f UNION ALL SELECT module, module, 0 FROM mo WHERE module NOT IN (SELECT module FROM f)"""
)
def q_coupling_functions(spark, d):
    return coupling.by_function(edges(spark, d))


@query(
    f"""WITH {ED}, b AS (SELECT caller_module AS module, caller_file AS file, seq, 0 AS side FROM ed UNION ALL SELECT callee_module, callee_file, seq, 1 FROM ed),
r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY seq, side, file) AS n FROM b) SELECT module, file FROM r WHERE n = 1"""
)
def q_coupling_files(spark, d):
    return coupling.first_file(edges(spark, d), "caller_line")


def _calls(spark, d) -> DataFrame:
    """Edges by order priority; a customer is a function, at the line of its number."""
    return edges(spark, d, "o_orderpriority").withColumnRenamed("o_orderpriority", "label").withColumn("caller_line", F.expr("cast(substring(caller_file, 2) as bigint)"))


CE = """ce AS (SELECT DISTINCT o_orderpriority AS label, a.n_name AS x, b.n_name AS y, c_mktsegment AS f, o_custkey AS line, 'c' || o_custkey AS xf, 's' || l_suppkey AS yf
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey
WHERE a.n_name <> b.n_name),
cs AS (SELECT label, 'function' AS kind, min(xf) AS file, line, x || '::' || f AS name, count(DISTINCT y) AS k, 'module:' || x || '/function:' || f AS scope FROM ce GROUP BY label, x, f, line
UNION ALL SELECT label, 'module', min(file), CAST(0 AS BIGINT), x, 0, 'module:' || x FROM (SELECT label, y AS x, yf AS file FROM ce) z WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.label = z.label AND ce.x = z.x) GROUP BY label, x),
ci AS (SELECT *, exp(-ln(2.0) * k / 3) AS s FROM cs)"""


@query(f"WITH {CE} SELECT label, kind, file, line, name, scope, k || ' outgoing cross-module edge(s)' AS detail, CAST(k AS DOUBLE) AS raw, round(s, 6) AS calibrated_score FROM ci")
def q_coupling_rows(spark, d):
    rows = dimensions.score_observations(dimensions.coupling_rows(_calls(spark, d), ["label"]), Policy())
    return rows.select("label", "kind", "file", "line", "name", rollup.key(F.col("scope_path")).alias("scope"), "detail", "raw", r6("calibrated_score"))


@query(
    f"""WITH {CE}, w AS (SELECT *, sum(ln(s)) OVER (PARTITION BY label) AS t, count(*) OVER (PARTITION BY label) AS n FROM ci)
SELECT label, file, line, name AS function_name, round(exp((t - ln(s)) / n) - exp(t / n), 9) AS responsibility FROM w WHERE s < 1 - 1e-12"""
)
def q_heatmap_coupling(spark, d):
    rows = dimensions.score_observations(dimensions.coupling_rows(_calls(spark, d), ["label"]), Policy())
    heat = attribution.itemized_heatmap(rows, ["label"], Aggregation(), score="calibrated_score")
    return heat.select("label", "file", "line", F.col("name").alias("function_name"), (F.round("responsibility", 9) + F.lit(0.0)).alias("responsibility"))


# ---- the corpus run with all five dimensions measured: a fingerprint belongs to the priority of its number modulo 5 ----

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MEASURED = (
    DIMS.replace("z AS (SELECT DISTINCT label, unnest(['duplication', 'coupling_density']) AS dimension, 1.0 AS score, CAST(0 AS BIGINT) AS item_count FROM co),\ndm AS (SELECT * FROM g UNION ALL SELECT * FROM e UNION ALL SELECT * FROM z)", "")
    + f"""fp AS (SELECT fn_id, {_PRIORITIES}[fn_id % 5 + 1] AS label, any_value(shape) AS s FROM fingerprints GROUP BY fn_id), lf AS (SELECT *, len(s) AS n FROM fp WHERE len(s) >= 5),
ex AS (SELECT label, s, count(*) AS c FROM lf GROUP BY label, s HAVING count(*) > 1), si AS (SELECT lf.* FROM lf ANTI JOIN ex USING (label, s)),
tr AS (SELECT DISTINCT label, fn_id, n, s[k] || '/' || s[k + 1] || '/' || s[k + 2] AS r FROM (SELECT *, unnest(range(1, n - 1)) AS k FROM si)), tn AS (SELECT fn_id, count(*) AS m FROM tr GROUP BY 1),
oo AS (SELECT x.label, x.fn_id AS a, y.fn_id AS b, count(*) AS o FROM tr x JOIN tr y ON x.label = y.label AND x.r = y.r AND x.fn_id < y.fn_id AND least(x.n, y.n) >= 0.5 * greatest(x.n, y.n) GROUP BY 1, 2, 3),
np AS (SELECT label, a, b FROM oo JOIN tn x ON x.fn_id = a JOIN tn y ON y.fn_id = b WHERE CAST(o AS DOUBLE) / (x.m + y.m - o) > 0.8),
dn AS (SELECT label, count(*) AS k FROM (SELECT label, a FROM np UNION SELECT label, b FROM np) GROUP BY 1), de AS (SELECT label, sum(c) AS k FROM ex GROUP BY 1),
du AS (SELECT label, 'duplication' AS dimension, 1 - (coalesce(any_value(de.k), 0) + coalesce(any_value(dn.k), 0)) / count(*) AS score, CAST(0 AS BIGINT) AS item_count FROM fp LEFT JOIN de USING (label) LEFT JOIN dn USING (label) GROUP BY 1),
ed AS (SELECT DISTINCT o_orderpriority AS label, a.n_name AS x, b.n_name AS y, c_mktsegment AS f
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_name <> b.n_name),
cf AS (SELECT label, x, f, count(DISTINCT y) AS k FROM ed GROUP BY 1, 2, 3),
cr AS (SELECT label, k FROM cf UNION ALL SELECT label, 0 FROM (SELECT label, y AS x FROM ed EXCEPT SELECT label, x FROM cf)),
cd AS (SELECT label, 'coupling_density' AS dimension, exp(-ln(2.0) * avg(k) / 3) AS score, count(*) AS item_count FROM cr GROUP BY 1),
dm AS (SELECT * FROM g UNION ALL SELECT * FROM e UNION ALL SELECT * FROM du UNION ALL SELECT * FROM cd)"""
)


def corpus_run(spark, d, top: int | None = 10) -> tuple[dimensions.Scored, DataFrame]:
    fn, by = corpus(spark, d), ["label"]
    obs = dimensions.bloat(fn, by).unionByName(dimensions.state_functions(fn, by)).unionByName(dimensions.economy(fn, by))
    fp = once(_t(spark, d, "fingerprints").select("fn_id", "name", "file", "line", "shape", "scope_path"), "fn_id")
    fp = fp.withColumn("label", F.element_at(F.array(*[F.lit(x) for x in _PRIORITIES]), (F.col("fn_id") % 5 + 1).cast("int")))
    # the functions of these edges are market segments: they have no line of their own
    calls = edges(spark, d, "o_orderpriority").withColumnRenamed("o_orderpriority", "label").withColumn("caller_line", F.lit(0))
    return corpora.run(obs, corpora.cohort_feed(fn, None, by), Policy(), top=top, fingerprints=fp, edges=calls, overhead=dimensions.overhead_rows(fn, by))


@query(f"WITH {MEASURED} SELECT label, dimension, round(score, 6) AS score, item_count FROM dm UNION ALL SELECT label, 'composite', round(CASE WHEN min(score) <= 0 THEN 0.0 ELSE exp(avg(ln(score))) END, 6), 5 FROM dm GROUP BY label")
def q_corpus_run(spark, d):
    sc, _ = corpus_run(spark, d)
    whole = sc.composite.select("label", F.lit("composite").alias("dimension"), "score", F.lit(5).cast("bigint").alias("item_count"))
    return sc.dimensions.unionByName(whole).select("label", "dimension", r6("score"), "item_count")


HEAT = (
    MEASURED
    + """, pc AS (SELECT label, exp(avg(ln(score))) AS c FROM dm GROUP BY label),
rs AS (SELECT a.label, a.dimension, a.score, any_value(c) AS c, sum(ln(b.score)) AS rest FROM dm a JOIN dm b ON a.label = b.label AND a.dimension <> b.dimension JOIN pc ON pc.label = a.label GROUP BY 1, 2, 3),
cl AS (SELECT DISTINCT o_orderpriority AS label, a.n_name AS x, b.n_name AS y, c_mktsegment AS f, 'c' || o_custkey AS xf, 's' || l_suppkey AS yf
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_name <> b.n_name),
im AS (SELECT label, 'bloat' AS dimension, file, line, name, exp(-ln(2.0) * pow(log2(greatest(CAST(lines AS DOUBLE), 1.0)) / log2(45.0), 3)) AS s FROM co WHERE NOT is_test
  UNION ALL SELECT label, 'state_cardinality', file, line, name, exp(-ln(2.0) * pow(bits / 4.0, 2)) FROM co WHERE NOT is_test AND bits > 0
  UNION ALL SELECT label, 'coupling_density', min(xf), 0, x || '::' || f, exp(-ln(2.0) * count(DISTINCT y) / 3) FROM cl GROUP BY label, x, f
  UNION ALL SELECT label, 'coupling_density', '', 0, y, 1.0 FROM (SELECT DISTINCT label, y FROM cl) z WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.label = z.label AND cl.x = z.y)),
iw AS (SELECT *, sum(ln(s)) OVER w AS t, count(*) OVER w AS n FROM im WINDOW w AS (PARTITION BY label, dimension)),
pa AS (SELECT fn_id, any_value(name) AS name, any_value(file) AS file, any_value(line) AS line FROM fingerprints GROUP BY fn_id),
dd AS (SELECT label, fn_id FROM lf SEMI JOIN ex USING (label, s) UNION SELECT label, a FROM np UNION SELECT label, b FROM np),
es AS (SELECT label, 'duplication' AS dimension, file, line, name FROM dd JOIN pa USING (fn_id) UNION ALL SELECT label, 'code_economy', file, line, name FROM co WHERE NOT is_test AND NOT is_pub),
ht AS (SELECT label, dimension, file, line, name AS function_name, exp((rest + (t - ln(s)) / n) / 5) - c AS r FROM iw JOIN rs USING (label, dimension) WHERE s < 1 - 1e-12
  UNION ALL SELECT label, dimension, file, line, name, (exp(rest / 5) - c) / count(*) OVER (PARTITION BY label, dimension) FROM es JOIN rs USING (label, dimension) WHERE score < 1 - 1e-12)"""
)


@query(f"WITH {HEAT} SELECT label, dimension, file, line, function_name, round(r, 9) AS responsibility FROM ht WHERE r >= 1e-12")
def q_heatmap_all(spark, d):
    _, heat = corpus_run(spark, d, None)
    return heat.select("label", "dimension", "file", "line", "function_name", (F.round("responsibility", 9) + F.lit(0.0)).alias("responsibility"))


@query(f"WITH {HEAT} SELECT label, dimension, count(*) AS entries, round(sum(r) + 1e-9, 6) AS total FROM ht WHERE r >= 1e-12 GROUP BY 1, 2")
def q_heatmap_all_totals(spark, d):
    _, heat = corpus_run(spark, d, None)
    return attribution.dimension_totals(heat, ["label"]).select("label", "dimension", "entries", rr("total", 6))


# ---- overlay lookup ----


@query(
    """WITH i AS (SELECT DISTINCT fn_id, name, file FROM fingerprints), h AS (SELECT DISTINCT hotspot_id, file, function_name, line FROM hotspots WHERE file IS NOT NULL),
o AS (SELECT function_name AS name, CASE WHEN hotspot_id % 3 = 0 THEN file ELSE replace(file, 'crates/', '') END AS file, min(line) AS value FROM h GROUP BY 1, 2),
e AS (SELECT i.*, o.value AS v FROM i LEFT JOIN o ON i.name = o.name AND i.file = o.file),
f AS (SELECT fn_id, o.value AS w, row_number() OVER (PARTITION BY fn_id ORDER BY o.file) AS n FROM e JOIN o ON e.name = o.name AND e.v IS NULL AND (suffix(e.file, '/' || o.file) OR suffix(o.file, '/' || e.file) OR e.file = o.file))
SELECT e.fn_id, coalesce(v, w) AS value FROM e LEFT JOIN f ON e.fn_id = f.fn_id AND n = 1"""
)
def q_overlay_lookup(spark, d):
    items = once(_t(spark, d, "fingerprints").select("fn_id", "name", "file"), "fn_id").withColumn("module_path", F.lit("m"))
    h = once(_t(spark, d, "hotspots").select("hotspot_id", "file", "function_name", "line").filter("file is not null"), "hotspot_id")
    table = h.groupBy(F.col("function_name").alias("name"), F.when(F.col("hotspot_id") % 3 == 0, F.col("file")).otherwise(F.replace(F.col("file"), F.lit("crates/"), F.lit(""))).alias("file")).agg(F.min("line").alias("value"))
    return overlay.overlay_lookup(items, table.withColumn("module_path", F.lit("m")), "value").select("fn_id", "value")


# ---- diffs: orders of two years, and heatmap rows of two periods ----


def _year(spark, d, y: int) -> DataFrame:
    o = _t(spark, d, "orders").filter(F.year("o_orderdate") == y).select("o_orderkey")
    fn = functions(spark, d).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return summaries.snapshot_summary(fn, user_types(spark, d))


_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({{t}}.{m} AS DOUBLE) AS value FROM {{t}}" for m in diffs.METRICS if m not in ("duplication_score", "total_bool_fields", "total_option_fields", "max_state_cardinality_log2"))
DF = f"""{FN}, {TY}, s1 AS (SELECT {_RAW_SUMMARY} FROM fn JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1995), s2 AS (SELECT {_RAW_SUMMARY} FROM fn JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1996),
same AS (SELECT 'duplication_score' AS metric, 0.0 AS value UNION ALL SELECT 'total_bool_fields', sum(k) FROM ty UNION ALL SELECT 'total_option_fields', 0 UNION ALL SELECT 'max_state_cardinality_log2', max(k) FROM ty),
l1 AS (SELECT * FROM same UNION ALL {_LONG.format(t="s1")}), l2 AS (SELECT * FROM same UNION ALL {_LONG.format(t="s2")}),
dd AS (SELECT metric, l1.value AS b, l2.value AS a, round(l2.value - l1.value + 1e-9, 5) + 0 AS dl, metric IN ('mean_assertions_per_function', 'mean_meaningful_assertions_per_function', 'test_density') AS hi FROM l1 JOIN l2 USING (metric))"""


@query(f"WITH {DF} SELECT metric, round(b + 1e-9, 5) AS before, round(a + 1e-9, 5) AS after, dl AS delta, CASE WHEN dl = 0 THEN 'unchanged' WHEN (dl > 0) = hi THEN 'improved' ELSE 'regressed' END AS assessment FROM dd")
def q_diff_summary(spark, d):
    out = diffs.diff_summaries(_year(spark, d, 1995), _year(spark, d, 1996))
    return out.select("metric", *[rr(c, 5) for c in ("before", "after", "delta")], "assessment")


@query(f"WITH {DF} SELECT metric, round(CASE WHEN hi THEN l.b - l.a ELSE l.a - l.b END + 1e-9, 5) + 0 AS delta FROM dd l")
def q_diff_vector(spark, d):
    return diffs.delta_vector(diffs.diff_summaries(_year(spark, d, 1995), _year(spark, d, 1996))).select("metric", rr("delta", 5))


@query(f"WITH {DF}, c AS (SELECT CASE WHEN dl = 0 THEN 'unchanged' WHEN (dl > 0) = hi THEN 'improved' ELSE 'regressed' END AS x FROM dd) SELECT count(*) FILTER (x = 'improved') AS improved, count(*) FILTER (x = 'regressed') AS regressed, count(*) FILTER (x = 'unchanged') AS unchanged FROM c")
def q_diff_counts(spark, d):
    return diffs.assessment_counts(diffs.diff_summaries(_year(spark, d, 1995), _year(spark, d, 1996)))


@query(f"WITH {DF} SELECT metric, round(a + 1e-9, 5) AS value FROM dd WHERE metric IN (" + ", ".join(f"'{m}'" for m in diffs.RAW_VECTOR) + ")")
def q_raw_vector(spark, d):
    return diffs.raw_vector(_year(spark, d, 1996)).select("metric", rr("value", 5))


_MID = "2025-03-15"
DH = f"""{HS}, b AS (SELECT file, function_name, dimension, min(responsibility) AS x FROM hs WHERE run_at < '{_MID}' GROUP BY ALL), a AS (SELECT file, function_name, dimension, min(responsibility) AS y FROM hs WHERE run_at >= '{_MID}' GROUP BY ALL),
dh AS (SELECT file, function_name, dimension, x, y, coalesce(y, 0) - coalesce(x, 0) AS dl, CASE WHEN x IS NULL THEN 'appeared' WHEN y IS NULL THEN 'disappeared' WHEN abs(coalesce(y, 0) - coalesce(x, 0)) < 1e-10 THEN 'unchanged' WHEN y < x THEN 'improved' ELSE 'regressed' END AS status FROM b FULL JOIN a USING (file, function_name, dimension))"""


def _heat_diff(spark, d) -> DataFrame:
    h = hotspots(spark, d)
    return diffs.diff_heatmaps(h.filter(F.col("run_at") < _MID), h.filter(F.col("run_at") >= _MID))


@query(f"WITH {DH} SELECT file, function_name, dimension, round(x + 1e-9, 6) AS before, round(y + 1e-9, 6) AS after, round(dl + 1e-9, 6) + 0 AS delta, status FROM dh")
def q_diff_heatmap(spark, d):
    return _heat_diff(spark, d).select("file", "function_name", "dimension", rr("before", 6), rr("after", 6), rr("delta", 6), "status")


@query(f"WITH {DH} SELECT " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("appeared", "disappeared", "improved", "regressed", "unchanged")) + " FROM dh")
def q_diff_heatmap_counts(spark, d):
    return diffs.status_counts(_heat_diff(spark, d))


@query(
    f"""WITH {DIMS}, x AS (SELECT dimension, score FROM dm WHERE label = '1-URGENT'), y AS (SELECT dimension, score FROM dm WHERE label = '5-LOW'), j AS (SELECT dimension, round(1 - x.score, 6) AS before, round(1 - y.score, 6) AS after, round(x.score - y.score, 6) + 0 AS delta, x.score - y.score AS dl FROM x JOIN y USING (dimension))
SELECT dimension, before, after, delta, CASE WHEN abs(dl) < 1e-10 THEN 'unchanged' WHEN dl < 0 THEN 'improved' ELSE 'regressed' END AS assessment FROM j"""
)
def q_diff_dimension(spark, d):
    dims = scored_corpus(spark, d).dimensions
    out = diffs.diff_dimensions(dims.filter("label = '1-URGENT'"), dims.filter("label = '5-LOW'"))
    return out.select("dimension", r6("before"), r6("after"), r6("delta"), "assessment")


@query(f"WITH {DIMS}, x AS (SELECT dimension, score FROM dm WHERE label = '1-URGENT'), y AS (SELECT dimension, score FROM dm WHERE label = '5-LOW') SELECT dimension, round(x.score - y.score, 6) + 0 AS delta FROM x JOIN y USING (dimension)")
def q_loss_delta(spark, d):
    dims = scored_corpus(spark, d).dimensions
    return diffs.strict_loss_delta(dims.filter("label = '1-URGENT'"), dims.filter("label = '5-LOW'")).select("dimension", r6("delta"))


# ---- matching, series and frames ----


def _fuzzy_sql(q: str) -> str:
    pos = "strpos({s}, '{c}')"
    steps, prev = ["SELECT fn_id, name, lower(name) AS s FROM (SELECT DISTINCT fn_id, name FROM fingerprints)"], None
    out = "WITH t0 AS (" + steps[0] + ")"
    score = []
    for i, c in enumerate(q):
        at = pos.format(s="s", c=c) if i == 0 else f"CASE WHEN p{i} > 0 AND strpos(substr(s, p{i} + 1), '{c}') > 0 THEN p{i} + strpos(substr(s, p{i} + 1), '{c}') ELSE 0 END"
        out += f", t{i + 1} AS (SELECT *, {at} AS p{i + 1} FROM t{i})"
        p = f"p{i + 1}"
        score.append(f"1 + CASE WHEN {p} = 1 OR substr(s, {p} - 1, 1) IN (' ', '-', '_') THEN 5 ELSE 0 END" + (f" + CASE WHEN {p} = p{i} + 1 THEN 3 ELSE 0 END" if i else f" + CASE WHEN {p} = 1 THEN 10 ELSE 0 END"))
    return out + f" SELECT fn_id, name, CAST({' + '.join(score)} AS BIGINT) AS score FROM t{len(q)} WHERE p{len(q)} > 0"


@query(_fuzzy_sql("mkey"))
def q_fuzzy_rank(spark, d):
    names = once(_t(spark, d, "fingerprints").select("fn_id", "name"), "fn_id")
    return matching.fuzzy_rank(names, "mkey", "name", "fn_id").select("fn_id", "name", "score")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end FROM events) SELECT user_id, event_id, from_end FROM r WHERE from_end <= 8")
def q_tail_n(spark, d):
    return frames.tail(_t(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 8).select("user_id", "event_id", "from_end")


@query("WITH m AS (SELECT event_type, max(value) AS m FROM events GROUP BY 1) SELECT event_id, CAST(CASE WHEN m > 0 THEN least(round(7.0 * value / m), 7) ELSE 0 END AS BIGINT) AS level FROM events JOIN m USING (event_type)")
def q_quantize8(spark, d):
    e = _t(spark, d, "events")
    m = e.groupBy("event_type").agg(F.max("value").alias("m"))
    return e.join(F.broadcast(m), "event_type").select("event_id", frames.levels(F.col("value"), F.col("m")).alias("level"))


@query(
    """WITH r AS (SELECT r_regionkey AS g, n_nationkey AS o, length(n_name) AS w, n_nationkey = max(n_nationkey) OVER (PARTITION BY r_regionkey) AS sel, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY o) AS e FROM r), b AS (SELECT *, e - w AS b, max(CASE WHEN sel THEN e END) OVER (PARTITION BY g) AS goal FROM e),
s AS (SELECT *, min(CASE WHEN goal - b <= 20 THEN b END) OVER (PARTITION BY g) AS s FROM b) SELECT g, n_name FROM s WHERE b >= s AND e <= s + 20"""
)
def q_visible_window(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    last = n.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("sel"))
    rows = n.join(last, "n_regionkey").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("o"), F.length("n_name").alias("w"), (F.col("n_nationkey") == F.col("sel")).alias("sel"), "n_name")
    return frames.visible_window(rows, "g", "o", "w", "sel", 20).select("g", "n_name")


EM = """em AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
lg AS (SELECT vec_id, label, k, v, abs(CAST(v AS DOUBLE) - lag(CAST(v AS DOUBLE)) OVER (PARTITION BY label, k ORDER BY vec_id)) AS d FROM em),
fd AS (SELECT label, vec_id, count(*) FILTER (d > 0.05) AS changed, sum(d) AS total, max(d) AS largest FROM lg WHERE d IS NOT NULL GROUP BY 1, 2)"""


def _vec(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings")


@query(f"WITH {EM} SELECT label, vec_id, changed, round(total, 5) AS total, round(largest, 6) AS largest FROM fd")
def q_frame_deltas(spark, d):
    return frames.frame_deltas(_vec(spark, d), "label", "vec_id", "embedding", 0.05).select("label", "vec_id", "changed", F.round("total", 5).alias("total"), r6("largest"))


@query(f"WITH {EM} SELECT label, round(CASE WHEN count(*) FILTER (total <> 0) < 2 THEN 0 ELSE stddev_pop(total) FILTER (total <> 0) / avg(total) FILTER (total <> 0) END, 6) AS smoothness FROM fd GROUP BY label")
def q_smoothness(spark, d):
    return frames.smoothness(frames.frame_deltas(_vec(spark, d), "label", "vec_id", "embedding"), "label").select("label", r6("smoothness"))


@query(f"WITH {EM}, c AS (SELECT label, k, max(CASE WHEN d > 0.5 THEN 1 ELSE 0 END) AS m FROM lg GROUP BY 1, 2) SELECT label, round(avg(m), 6) AS coverage FROM c GROUP BY label")
def q_coverage(spark, d):
    return frames.coverage(_vec(spark, d), "label", "vec_id", "embedding", 0.5).select("label", r6("coverage"))


@query(
    f"""WITH {EM}, e AS (SELECT label, min(vec_id) AS a, max(vec_id) AS b FROM em GROUP BY 1)
SELECT e.label, round(avg(abs(CAST(x.v AS DOUBLE) - CAST(y.v AS DOUBLE))), 6) AS distance FROM e JOIN em x ON x.vec_id = a JOIN em y ON y.vec_id = b AND x.k = y.k GROUP BY e.label"""
)
def q_periodicity(spark, d):
    return frames.periodicity(_vec(spark, d), "label", "vec_id", "embedding").select("label", r6("distance"))


# ---- colour ----

_STOPS = [(0.0, (0, 0, 128)), (0.5, (0, 200, 0)), (1.0, (255, 40, 0))]


def _ramp_sql(k: int) -> str:
    (p0, a), (p1, b), (p2, c) = _STOPS
    return f"CAST(round(CASE WHEN t <= {p0} THEN {a[k]} WHEN t <= {p1} THEN {a[k]} + ({b[k]} - {a[k]}) * (t - {p0}) / {p1 - p0} WHEN t <= {p2} THEN {b[k]} + ({c[k]} - {b[k]}) * (t - {p1}) / {p2 - p1} ELSE {c[k]} END) AS BIGINT)"


RA = "ra AS (SELECT event_id, CAST(value AS DOUBLE) / (SELECT max(value) FROM events) AS t FROM events), cl AS (SELECT event_id, " + ", ".join(f"{_ramp_sql(k)} AS {n}" for k, n in enumerate("rgb")) + " FROM ra)"


def _colours(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    top = e.agg(F.max("value").alias("m"))
    return e.crossJoin(F.broadcast(top)).select("event_id", color.ramp(F.col("value") / F.col("m"), _STOPS).alias("c")).select("event_id", "c.*")


@query(f"WITH {RA} SELECT event_id, r, g, b FROM cl")
def q_ramp(spark, d):
    return _colours(spark, d)


_LIN = "CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
_LUM = " + ".join(f"{w} * {_LIN.format(c=c)}" for w, c in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b")))


@query(f"WITH {RA} SELECT event_id, round(1.05 / (({_LUM}) + 0.05), 5) AS contrast, round(sqrt((255.0 - r) * (255 - r) + (255.0 - g) * (255 - g) + (255.0 - b) * (255 - b)) / (255 * sqrt(3.0)), 5) AS distance, round(CAST(0.299 * r + 0.587 * g + 0.114 * b AS DOUBLE), 5) AS perceived FROM cl")
def q_contrast(spark, d):
    c = _colours(spark, d)
    rgb = [F.col(x).cast("double") for x in "rgb"]
    lum = color.relative_luminance(*rgb)
    white = [F.lit(255.0)] * 3
    return c.select("event_id", F.round(color.contrast_ratio(F.lit(1.0), lum), 5).alias("contrast"), F.round(color.rgb_distance(white, rgb), 5).alias("distance"), F.round(color.perceived_luminance(*rgb), 5).alias("perceived"))


# ---- debouncing and easing ----


def _event_ms(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
w AS (SELECT user_id, n, ms, ms AS anchor FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, e.ms, CASE WHEN e.ms < w.anchor + 1800000 THEN w.anchor ELSE e.ms END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, anchor, anchor + 1800000 AS fires_at, count(*) AS events FROM w GROUP BY user_id, anchor"""
)
def q_debounce(spark, d):
    return debounce.debounce(_event_ms(spark, d), "user_id", "ms", 1_800_000)


@query()
def q_easing(spark, d):
    e = _event_ms(spark, d).withColumn("s", F.col("ms") / 1000.0)
    return debounce.ease(e, "user_id", "s", "value", rate=0.001)


# ---- details, fallbacks and screens ----


@query(
    f"""WITH {ND}, e AS (SELECT l.fn_id, 0 AS o, 'same as ' || f AS t FROM lf l JOIN ex USING (s)), n AS (SELECT a AS fn_id, 1 AS o, 'near ' || b AS t FROM np UNION ALL SELECT b, 1, 'near ' || a FROM np), x AS (SELECT DISTINCT * FROM (SELECT * FROM e UNION ALL SELECT * FROM n))
SELECT fn_id, string_agg(t, '; ' ORDER BY o, t) AS detail FROM x GROUP BY fn_id"""
)
def q_dup_details(spark, d):
    fp = fingerprints(spark, d)
    return duplicates.details(duplicates.exact_members(fp), duplicates.near_pairs(fp))


@query(f"WITH {DIMS}, s AS (SELECT DISTINCT label FROM co), v AS (SELECT label, row_number() OVER (ORDER BY label) / 10.0 AS density FROM s) SELECT label, 'coupling_density' AS dimension, round(1 - CASE WHEN label < '3' THEN density ELSE 0 END, 6) AS score FROM v")
def q_coupling_fallback(spark, d):
    labels = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("label")).distinct()
    saved = labels.filter("label < '3'").select("label", (F.left("label", F.lit(1)).cast("double") / 10).alias("density"))
    return dimensions.coupling_fallback(saved, labels, ["label"]).select("label", "dimension", r6("score"))


@query(
    f"""WITH {DIMS}, p AS (SELECT label, exp(sum(ln(score)) FILTER (dimension <> 'bloat') / 5) - exp(avg(ln(score))) AS r FROM dm GROUP BY label)
SELECT label, '<codebase>' AS file, CAST(0 AS BIGINT) AS line, '<codebase>' AS function_name, 'bloat' AS dimension, round(r, 6) AS responsibility FROM p WHERE r >= 1e-12"""
)
def q_heatmap_whole(spark, d):
    dims = scored_corpus(spark, d).dimensions
    rest = attribution.composite_with(dims.filter("dimension <> 'bloat'"), ["label"])
    own = dims.filter("dimension = 'bloat'").select("label", "score")
    return attribution.whole_share(own, rest, "bloat", ["label"]).withColumn("responsibility", F.round("responsibility", 6) + F.lit(0.0))


@query(
    f"""WITH {NT}, t AS (SELECT sum(c) AS t FROM rt), a AS (SELECT 'module:' || r_name AS key, r_name, CAST(1 AS BIGINT) AS depth, CAST(greatest(floor(80 * c / t), 1) AS BIGINT) AS cells FROM rt, t)
SELECT key, depth, cells FROM a UNION ALL SELECT 'module:ASIA/module:' || n_name, 2, CAST(greatest(floor(a.cells * nt.c / sum(nt.c) OVER ()), 1) AS BIGINT) FROM nt JOIN a ON nt.r_name = a.r_name WHERE nt.r_name = 'ASIA'"""
)
def q_flame_rows(spark, d):
    return rollup.flame_rows(_nation_tree(spark, d), "module:ASIA", 80)


@query(f"WITH {NT}, t AS (SELECT r_name, n_name FROM nt ORDER BY r_name, n_name LIMIT 1) SELECT CAST(1 AS BIGINT) AS depth, 'module:' || r_name AS key FROM t UNION ALL SELECT 2, 'module:' || r_name || '/module:' || n_name FROM t")
def q_ancestors(spark, d):
    tree = _nation_tree(spark, d)
    target = tree.filter("depth = 2").select(rollup.key(F.col("path")).alias("k")).orderBy("k").first()["k"]
    return rollup.ancestors(tree, target)


CE = "ce AS (SELECT event_type AS frame, user_id % 20 AS y, user_id AS x, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE chr(CAST(97 + event_id % 26 AS INT)) END AS symbol, event_id % 7 AS fg FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events) WHERE n = 1)"


def _cells(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    first = e.groupBy("event_type", "user_id").agg(F.min("event_id").alias("event_id"))
    sym = F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.char(97 + F.col("event_id") % 26))
    return first.select(F.col("event_type").alias("frame"), (F.col("user_id") % 20).alias("y"), F.col("user_id").alias("x"), sym.alias("symbol"), (F.col("event_id") % 7).alias("fg"))


@query(f"WITH {CE} SELECT DISTINCT fg FROM ce WHERE trim(symbol) <> ''")
def q_palette(spark, d):
    return frames.palette(_cells(spark, d))


@query(f"WITH {CE} SELECT frame, y, rtrim(string_agg(symbol, '' ORDER BY x)) AS line FROM ce GROUP BY frame, y")
def q_buffer_text(spark, d):
    return frames.buffer_text(_cells(spark, d), "frame", "y", "x", "symbol")


@query(f"WITH {RA} SELECT event_id FROM cl WHERE 1.05 / (({_LUM}) + 0.05) < 3.0")
def q_contrast_violations(spark, d):
    rows = _colours(spark, d).select("event_id", F.struct("r", "g", "b").alias("fg"))
    white = F.struct(*[F.lit(255).alias(x) for x in "rgb"])
    return rows.filter(color.contrast_violation(F.col("fg"), white, F.lit("x"), 3.0)).select("event_id")


@query("SELECT user_id, event_id, least(greatest(user_id - 9, 0), 140) AS first_row FROM events")
def q_page_window(spark, d):
    return _t(spark, d, "events").select("user_id", "event_id", frames.page_window(F.col("user_id"), 10, F.lit(150)).alias("first_row"))


__all__ = ["QUERIES", "SQL"]
