"""The pN_ queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.delivery import once
from ..session import Scratch
from . import components, leakage, mixing, neardup, percentiles, ranking, spans, stuffed, topn


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "near_pairs").select(F.col("a.fn_id").alias("a"), F.col("b.fn_id").alias("b"))
    groups = components.links_of_groups(_t(spark, d, "duplicate_groups"), F.col("functions.fn_id"))
    found = components.connected_components(pairs.unionByName(groups), "a", "b")
    return found.select(F.col("node").alias("fn_id"), F.col("component").alias("component_id"))


P1_SQL = """
WITH RECURSIVE g AS (SELECT [f.fn_id for f in functions if f.fn_id IS NOT NULL] AS m FROM duplicate_groups),
l AS (SELECT a.fn_id AS x, b.fn_id AS y FROM near_pairs WHERE a.fn_id IS NOT NULL AND b.fn_id IS NOT NULL
      UNION ALL SELECT list_min(m), unnest(m) FROM g WHERE len(m) > 0),
e AS (SELECT x, y FROM l WHERE x <> y UNION SELECT y, x FROM l WHERE x <> y),
r AS (SELECT DISTINCT x AS fn_id, x AS other FROM e
      UNION SELECT r.fn_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT fn_id, min(other) AS component_id FROM r GROUP BY fn_id
"""


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_per_group(_t(spark, d, "hotspots"), ["file", "dimension"], "responsibility", ["line", "function_name"], "hotspot_id", 3)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top(spark, d).select("hotspot_id")


P2_SQL = """
WITH h AS (SELECT file, dimension, responsibility, line, function_name, hotspot_id FROM hotspots
           WHERE file IS NOT NULL AND dimension IS NOT NULL AND responsibility IS NOT NULL AND NOT isnan(responsibility)
           GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file, dimension
        ORDER BY responsibility DESC, line, encode(function_name), hotspot_id) AS position FROM h)
SELECT {cols} FROM r WHERE position <= 3
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.near_duplicates(_t(spark, d, "fingerprints"), "fn_id", "shape")
    return neardup.expand(found).select(F.col("a").alias("fn_id_a"), F.col("b").alias("fn_id_b"))


P3_SQL = """
WITH f AS (SELECT fn_id, any_value(shape) AS s FROM fingerprints WHERE len(shape) >= 20 GROUP BY fn_id),
g AS (SELECT DISTINCT fn_id, s[k] || '/' || s[k + 1] || '/' || s[k + 2] AS r FROM (SELECT fn_id, s, unnest(range(1, len(s) - 1)) AS k FROM f)),
n AS (SELECT fn_id, count(*) AS n FROM g GROUP BY fn_id),
o AS (SELECT x.fn_id AS a, y.fn_id AS b, count(*) AS o FROM g x JOIN g y ON x.r = y.r AND x.fn_id < y.fn_id GROUP BY 1, 2)
SELECT a AS fn_id_a, b AS fn_id_b FROM o JOIN n x ON x.fn_id = a JOIN n y ON y.fn_id = b WHERE CAST(o AS DOUBLE) / (x.n + y.n - o) > 0.8
"""


P3_GROUPS_SQL = (
    P3_SQL.replace("WITH f AS", "WITH RECURSIVE f AS").replace("SELECT a AS fn_id_a, b AS fn_id_b", ", p AS (SELECT a, b")
    + """), e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
r AS (SELECT DISTINCT x AS fn_id, x AS other FROM e UNION SELECT r.fn_id, e.y FROM r JOIN e ON r.other = e.x),
k AS (SELECT fn_id, min(fn_id) OVER (PARTITION BY s) AS class_id FROM f)
SELECT fn_id, any_value(class_id) AS class_id, min(other) AS group_id FROM r JOIN k USING (fn_id) GROUP BY fn_id"""
)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each function with at least one partner, its class of equal shapes and the group that near-duplicates bring it together with."""
    found = neardup.near_duplicates(_t(spark, d, "fingerprints"), "fn_id", "shape", every_pair=False)
    links = found.pairs.select("a", "b").unionByName(found.members.select(F.col("class").alias("a"), F.col("id").alias("b")))
    groups = components.connected_components(links, "a", "b")
    return found.members.join(groups, F.col("id") == F.col("node")).select(F.col("id").alias("fn_id"), F.col("class").alias("class_id"), F.col("component").alias("group_id"))


def p4_quartiles(spark: SparkSession, d: str) -> DataFrame:
    q = percentiles.exact_percentiles(_t(spark, d, "observations"), ["label", "cohort"], "raw", "obs_id", [0.25, 0.5, 0.75])
    return q.select("label", "cohort", "n", *[F.col(f"q{i}").alias(c) for i, c in enumerate(["q25", "q50", "q75"])])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored quartiles that stand more than five percentile points off. A stored quartile that is null lies nowhere."""
    obs = percentiles.exact_percentiles(_t(spark, d, "observations"), ["label", "cohort"], "raw", "obs_id", [0.2, 0.3, 0.45, 0.55, 0.7, 0.8])
    stats = once(_t(spark, d, "cohort_stats").select("label", "cohort", "q25", "q50", "q75", "ingested_at"), "label", "cohort").drop("ingested_at")
    off = F.lit(False)
    for i, c in enumerate(["q25", "q50", "q75"]):
        off = off | F.coalesce((F.col(c) < F.col(f"q{2 * i}")) | (F.col(c) > F.col(f"q{2 * i + 1}")), F.lit(False))
    return stats.join(obs, ["label", "cohort"]).filter(off).select("label", "cohort")


P4_BASE = """WITH o AS (SELECT DISTINCT obs_id, label, cohort, raw FROM observations WHERE raw IS NOT NULL AND isfinite(raw))"""
P4_QUARTILES_SQL = (
    P4_BASE
    + """, l AS (SELECT label, cohort, count(*) AS n, list_sort(list(raw)) AS v FROM o GROUP BY label, cohort),
h AS (SELECT *, CAST(n - 1 AS DOUBLE) * CAST(0.25 AS DOUBLE) AS h1, CAST(n - 1 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS h2, CAST(n - 1 AS DOUBLE) * CAST(0.75 AS DOUBLE) AS h3 FROM l)
SELECT label, cohort, n, """
    + ", ".join(
        f"v[CAST(floor(h{i}) AS BIGINT) + 1] + (v[least(CAST(floor(h{i}) AS BIGINT) + 2, n)] - v[CAST(floor(h{i}) AS BIGINT) + 1]) * (h{i} - floor(h{i})) AS {q}"
        for i, q in ((1, "q25"), (2, "q50"), (3, "q75"))
    )
    + " FROM h"
)
P4_FOUND_SQL = (
    P4_BASE
    + """, q AS (SELECT label, cohort, quantile_cont(raw, [0.2, 0.3, 0.45, 0.55, 0.7, 0.8]) AS b FROM o GROUP BY label, cohort),
s AS (SELECT DISTINCT label, cohort, q25, q50, q75 FROM cohort_stats)
SELECT label, cohort FROM s JOIN q USING (label, cohort)
WHERE q25 < b[1] OR q25 > b[2] OR q50 < b[3] OR q50 > b[4] OR q75 < b[5] OR q75 > b[6]"""
)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_t(spark, d, "fingerprints"), "fn_id", "shape").withColumnRenamed("id", "fn_id")


P5_SQL = """
WITH f AS (SELECT fn_id, any_value(shape) AS s FROM fingerprints WHERE len(shape) >= 40 GROUP BY fn_id),
w AS (SELECT fn_id, k, array_to_string(s[k:k + 39], '/') AS w FROM (SELECT fn_id, s, unnest(range(1, len(s) - 38)) AS k FROM f)),
r AS (SELECT w FROM w GROUP BY w HAVING min(fn_id) <> max(fn_id)),
c AS (SELECT fn_id, k, k - lag(k, 1, -1000) OVER (PARTITION BY fn_id ORDER BY k) > 40 AS new FROM w WHERE w IN (SELECT w FROM r)),
g AS (SELECT fn_id, k, sum(CAST(new AS INT)) OVER (PARTITION BY fn_id ORDER BY k) AS g FROM c)
SELECT fn_id, min(k) - 1 AS span_start, max(k) + 39 AS span_end FROM g GROUP BY fn_id, g
"""


P5_SHARES_SQL = (
    P5_SQL.replace("SELECT fn_id, min(k) - 1 AS span_start, max(k) + 39 AS span_end FROM g GROUP BY fn_id, g", ", sp AS (SELECT fn_id, max(k) + 39 - (min(k) - 1) AS n FROM g GROUP BY fn_id, g)")
    + """, a AS (SELECT fn_id, any_value(name) AS name, any_value(file) AS file, any_value(len(shape)) AS tokens FROM fingerprints WHERE len(shape) > 0 GROUP BY fn_id)
SELECT a.fn_id, name, file, tokens, CAST(coalesce(sum(n), 0) AS BIGINT) AS shared FROM a LEFT JOIN sp USING (fn_id) GROUP BY ALL"""
)


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each function's shape is shared elsewhere, by name and file."""
    f = once(_t(spark, d, "fingerprints").select("fn_id", "name", "file", F.size("shape").cast("bigint").alias("tokens")), "fn_id")
    s = p5_found(spark, d).groupBy("fn_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    return f.filter("tokens > 0").join(s, "fn_id", "left").select("fn_id", "name", "file", "tokens", F.coalesce("shared", F.lit(0)).alias("shared"))


#: The five dimensions.
DIMENSIONS = ["bloat", "code_economy", "coupling_density", "duplication", "state_cardinality"]


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """(label, score, value) of the eleven scores, all turned so that high is good."""
    res = once(_t(spark, d, "experiment_results").select("label", "composite_score"), "label").select("label", F.lit("composite").alias("score"), F.col("composite_score").alias("value"))
    dims = once(_t(spark, d, "experiment_dimensions").select("label", "name", "score", "loss", "normalized"), "label", "name").filter(F.col("name").isin(DIMENSIONS))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    dims = dims.select("label", F.explode(F.array(F.struct(F.concat(F.lit("score "), "name").alias("score"), F.coalesce(real("score"), 1 - real("loss")).alias("value")), F.struct(F.concat(F.lit("normalized "), "name").alias("score"), (-real("normalized")).alias("value")))).alias("x"))
    return res.unionByName(dims.select("label", "x.score", "x.value"))


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    names = ["composite", *[f"{k} {x}" for k in ("score", "normalized") for x in DIMENSIONS]]
    return ranking.rank_walk(p6_scores(spark, d), "label", "score", "value", names)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = Scratch(spark).save(p6_ranking(spark, d))
    return ranked.filter(F.col("position") <= ranked.count() // 10).select("label")


P6_SQL = """
WITH r AS (SELECT label, any_value(composite_score) AS v FROM experiment_results GROUP BY label),
e AS (SELECT DISTINCT label, name, score, loss, normalized FROM experiment_dimensions
      WHERE name IN ('bloat', 'code_economy', 'coupling_density', 'duplication', 'state_cardinality')),
s AS (SELECT label, 'composite' AS k, v FROM r
      UNION ALL SELECT label, 's ' || name, CASE WHEN score IS NOT NULL AND NOT isnan(score) THEN score ELSE 1 - loss END FROM e
      UNION ALL SELECT label, 'n ' || name, -normalized FROM e),
ok AS (SELECT label, k, v FROM s WHERE v IS NOT NULL AND NOT isnan(v)),
f AS (SELECT label, k, v FROM ok WHERE label IN (SELECT label FROM ok GROUP BY label HAVING count(*) = 11)),
p AS (SELECT label, 2 * rank() OVER (PARTITION BY k ORDER BY v DESC) + count(*) OVER (PARTITION BY k, v) AS twice FROM f),
t AS (SELECT label, row_number() OVER (ORDER BY sum(twice), label) AS position, count(*) OVER () AS n FROM p GROUP BY label)
SELECT label FROM t WHERE position <= n // 10
"""


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


P7_SQL = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r)
"""


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = mixing.token_counts(_t(spark, d, "documents"))
    # counted once and written: the plan and the draw both read the counts
    counts = Scratch(spark).save(counts)
    return counts, mixing.mixing_plan(counts, _t(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[1].filter("falls_short").select("source")


#: Sizes in words: by the tables' definition common tokenizers give the same answer, so plain words must as well.
P8_SQL = """
WITH d AS (SELECT DISTINCT doc_id, lower(trim(source)) AS source, len(regexp_extract_all(coalesce(text, ''), '\\w+|[^\\w\\s]')) AS n FROM documents),
z AS (SELECT source, sum(n) AS size FROM d GROUP BY source),
t AS (SELECT m.source, target_share, max_repeats, coalesce(size, 0) AS size FROM mix_targets m LEFT JOIN z ON lower(trim(m.source)) = z.source)
SELECT source FROM t WHERE max_repeats * size < target_share * (SELECT sum(size) FROM t)
"""


def p8_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[1]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    counts, plan = _plan(spark, d)
    return mixing.draw(counts, plan, seed=17)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed.stuffed_pages(_t(spark, d, "documents")).select("doc_id")


def p9_pages(spark: SparkSession, d: str) -> DataFrame:
    return stuffed.page_evidence(_t(spark, d, "documents"))


def p9_phrases(spark: SparkSession, d: str) -> DataFrame:
    return stuffed.phrase_replication(_t(spark, d, "documents"))


#: Of every four consecutive five-word phrases the one whose first word is least (the last of equal ones).
P9_PHRASES_SQL = """
WITH d AS (SELECT DISTINCT doc_id, coalesce(label, '') AS host, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
s AS (SELECT *, len(w) - 4 AS m FROM d),
o AS (SELECT doc_id, host, w, k, w[k:least(k + 3, m)] AS f FROM (SELECT *, unnest(range(1, greatest(1, m - 3) + 1)) AS k FROM s WHERE m > 0)),
c AS (SELECT DISTINCT doc_id, host, w, k + len(f) - list_position(list_reverse(f), list_min(f)) AS b FROM o),
p AS (SELECT DISTINCT doc_id, host, array_to_string(w[b:b + 4], ' ') AS p FROM c),
r AS (SELECT p FROM p GROUP BY p HAVING count(DISTINCT host) > 1),
n AS (SELECT doc_id, count(*) AS phrases, count(r.p) AS replicated FROM p LEFT JOIN r USING (p) GROUP BY doc_id)
SELECT DISTINCT doc_id, coalesce(phrases, 0) AS phrases, coalesce(replicated, 0) AS replicated FROM d LEFT JOIN n USING (doc_id)
"""


def p9_every_phrase(spark: SparkSession, d: str) -> DataFrame:
    return stuffed.phrase_replication(_t(spark, d, "documents"), window=1)


#: All five-word phrases.
P9_EVERY_PHRASE_SQL = """
WITH d AS (SELECT DISTINCT doc_id, coalesce(label, '') AS host, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
p AS (SELECT DISTINCT doc_id, host, array_to_string(w[k:k + 4], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) > 4)),
r AS (SELECT p FROM p GROUP BY p HAVING count(DISTINCT host) > 1),
n AS (SELECT doc_id, count(*) AS phrases, count(r.p) AS replicated FROM p LEFT JOIN r USING (p) GROUP BY doc_id)
SELECT DISTINCT doc_id, coalesce(phrases, 0) AS phrases, coalesce(replicated, 0) AS replicated FROM d LEFT JOIN n USING (doc_id)
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_top": p2_top, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_quartiles": p4_quartiles, "p5_found": p5_found, "p5_shares": p5_shares, "p6_found": p6_found, "p6_ranking": p6_ranking, "p7_found": p7_found, "p8_found": p8_found, "p8_plan": p8_plan, "p8_mix": p8_mix, "p9_found": p9_found, "p9_pages": p9_pages, "p9_phrases": p9_phrases, "p9_every_phrase": p9_every_phrase}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL,
        "p2_found": P2_SQL.format(cols="hotspot_id"),
        "p2_top": P2_SQL.format(cols="file, dimension, responsibility, line, function_name, hotspot_id, position"),
        "p3_found": P3_SQL,
        "p3_groups": P3_GROUPS_SQL,
        "p4_found": P4_FOUND_SQL,
        "p4_quartiles": P4_QUARTILES_SQL,
        "p5_found": P5_SQL,
        "p5_shares": P5_SHARES_SQL,
        "p6_found": P6_SQL,
        "p7_found": P7_SQL,
        "p8_found": P8_SQL,
        "p9_phrases": P9_PHRASES_SQL,
        "p9_every_phrase": P9_EVERY_PHRASE_SQL,
    }
