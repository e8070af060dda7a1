"""More of the driver's queries: orders of outputs, navigation in trees, semantic relations, small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import color, text
from ..operators import attribution, duplicates, entropy, matching, navigation, orders, overlay, rollup
from ..operators.delivery import numbered, once
from ..sources import rust, semantic
from . import corpus as corpora
from .queries import DH, EN, FN, HS, ND, NT, TK, _entries, _ENT, _heat_diff, _nation_tree, _t, docs, fingerprints, functions, hotspots, query, r6, rr

# ---- outputs in their stated order ----


@query(f"WITH {TK}, e AS (SELECT doc_id, {_ENT} FROM tk GROUP BY doc_id) SELECT doc_id, normalized, row_number() OVER (ORDER BY normalized, doc_id) AS position FROM e")
def q_order_entropy(spark, d):
    rows = entropy.entropy(entropy.token_counts(docs(spark, d), ["doc_id"]), ["doc_id"]).select("doc_id", r6("normalized"))
    return numbered(rows, orders.entropy_order(item="doc_id"))


@query(f"WITH {ND} SELECT CAST(n AS BIGINT) AS shape_length, c AS members, f AS first, row_number() OVER (ORDER BY n DESC, f) AS position FROM ex")
def q_order_groups(spark, d):
    return numbered(duplicates.exact_groups(fingerprints(spark, d)), orders.group_order())


_PLACE = "pl AS (SELECT fn_id, any_value(file) AS file, any_value(line) AS line, any_value(name) AS name FROM fingerprints GROUP BY fn_id)"


@query(f"WITH {ND}, {_PLACE} SELECT a, b, round(sim, 6) AS similarity, row_number() OVER (ORDER BY round(sim, 6) DESC, file NULLS FIRST, line NULLS FIRST, name NULLS FIRST, a, b) AS position FROM np JOIN pl ON a = fn_id")
def q_order_pairs(spark, d):
    places = once(_t(spark, d, "fingerprints").select(F.col("fn_id").alias("a"), "file", "line", "name"), "a")
    pairs = duplicates.near_pairs(fingerprints(spark, d)).select("a", "b", r6("similarity")).join(places, "a")
    return numbered(pairs, orders.pair_order(last=("a", "b"))).select("a", "b", "similarity", "position")


@query(
    f"""WITH {ND}, {_PLACE}, du AS (SELECT fn_id FROM lf WHERE s IN (SELECT s FROM ex) UNION SELECT a FROM np UNION SELECT b FROM np)
SELECT fn_id, row_number() OVER (ORDER BY file NULLS FIRST, line NULLS FIRST, name NULLS FIRST, fn_id) AS position FROM du JOIN pl USING (fn_id)"""
)
def q_order_observations(spark, d):
    fp = fingerprints(spark, d)
    own = duplicates.details(duplicates.exact_members(fp), duplicates.near_pairs(fp)).select("fn_id")
    places = once(_t(spark, d, "fingerprints").select("fn_id", "file", "line", "name"), "fn_id")
    return numbered(own.join(places, "fn_id"), orders.place_order("fn_id")).select("fn_id", "position")


@query(
    f"""WITH {DH}, c AS (SELECT file, function_name, dimension, round(dl + 1e-9, 6) + 0 AS delta FROM dh WHERE status IN ('improved', 'regressed'))
SELECT *, row_number() OVER (ORDER BY abs(delta) DESC, file, function_name NULLS FIRST, dimension) AS position FROM c"""
)
def q_order_changes(spark, d):
    rows = _heat_diff(spark, d).filter(F.col("status").isin("improved", "regressed")).select("file", "function_name", "dimension", rr("delta", 6))
    return numbered(rows, orders.change_order(["file", "function_name", "dimension"]))


@query(f"WITH {HS} SELECT hotspot_id, row_number() OVER (ORDER BY responsibility DESC, dimension, file, line NULLS FIRST, function_name NULLS FIRST, hotspot_id) AS position FROM hs")
def q_order_heatmap(spark, d):
    return numbered(hotspots(spark, d), [*attribution.heatmap_order(), "hotspot_id"]).select("hotspot_id", "position")


# ---- trees of the scope paths ----


@query(
    f"""WITH {EN}, n AS (SELECT DISTINCT key, k, array_to_string([x.kind || ':' || x.name for x in p[1:k - 1]], '/') AS up FROM px)
SELECT n.key, CASE WHEN k > 1 THEN up END AS parent, EXISTS (SELECT 1 FROM n m WHERE m.up = n.key AND m.k > 1) AS has_children FROM n"""
)
def q_tree_cache(spark, d):
    return navigation.cache(rollup.rollup_tree(_entries(spark, d)))


TR = (
    EN
    + """, tn AS (SELECT key, k, any_value(array_to_string([x.kind || ':' || x.name for x in p[1:k - 1]], '/')) AS up, any_value(p[k].name) AS name, any_value(p[k].kind) AS kind, sum(CAST(round(r * 1e6) AS BIGINT)) AS r FROM px GROUP BY key, k),
tk AS (SELECT *, row_number() OVER w AS i, row_number() OVER w = count(*) OVER (PARTITION BY up, k) AS last FROM tn WINDOW w AS (PARTITION BY up, k ORDER BY r DESC, name, kind)),
ta AS (SELECT DISTINCT key, k, unnest(range(1, k + 1)) AS j, p FROM px), tw AS (SELECT DISTINCT key, j, array_to_string([x.kind || ':' || x.name for x in p[1:j]], '/') AS a FROM ta)"""
)


def _tree(spark, d) -> DataFrame:
    """The tree of the observations, in whole millionths, so that the order of a sum's terms can't decide between siblings."""
    return rollup.rollup_tree(_entries(spark, d).withColumn("responsibility", F.round(F.col("responsibility") * 1e6).cast("bigint")))


@query(f"WITH {TR} SELECT tw.key, string_agg(CAST(i AS VARCHAR), '.' ORDER BY j) AS ids FROM tw JOIN tk ON tk.key = a GROUP BY tw.key")
def q_scope_pre_order(spark, d):
    return rollup.pre_order(_tree(spark, d)).select(rollup.key(F.col("path")).alias("key"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ".").alias("ids"))


@query(f"WITH {TR} SELECT tw.key, string_agg(CASE WHEN last THEN 'last' ELSE 'inner' END, ' ' ORDER BY j) AS trail FROM tw JOIN tk ON tk.key = a GROUP BY tw.key")
def q_tree_trail(spark, d):
    return navigation.trail(_tree(spark, d)).select("key", F.array_join("trail", " ").alias("trail"))


@query(f"WITH {TR} SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS orphans, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS bad_depth, CAST(0 AS BIGINT) AS bad_amount FROM tn")
def q_tree_violations(spark, d):
    return navigation.violations(_tree(spark, d))


@query(f"WITH {TR}, g AS (SELECT min(key) AS goal FROM tn WHERE k = 2) SELECT key, k AS depth, r AS responsibility FROM tn, g WHERE key = goal")
def q_tree_find(spark, d):
    tree = _tree(spark, d)
    goal = tree.filter("depth = 2").agg(F.min(rollup.key(F.col("path")))).first()[0]
    return navigation.find(tree, goal).select(rollup.key(F.col("path")).alias("key"), "depth", "responsibility")


@query(
    f"""WITH {NT}, tgt AS (SELECT r_name, k FROM no JOIN ro USING (r_name) ORDER BY r_name, n_name LIMIT 1)
SELECT 'module:' || no.r_name || '/module:' || no.n_name AS key, CASE WHEN ro.r_name = t.r_name THEN 'direct' WHEN ro.k <= t.k THEN 'on_route' ELSE 'unrelated' END AS trail FROM no JOIN ro USING (r_name), tgt t"""
)
def q_relation_trail(spark, d):
    tree = _nation_tree(spark, d)
    target = tree.filter("depth = 2").agg(F.min(rollup.key(F.col("path")))).first()[0]
    return navigation.relation_trail(tree, target).select("key", F.array_join("trail", " ").alias("trail"))


# ---- semantic relations ----


@query(
    """WITH r AS (SELECT file AS p, min(responsibility) AS v FROM hotspots WHERE file IS NOT NULL AND NOT isnan(responsibility) GROUP BY file), t AS (SELECT DISTINCT fn_id, file FROM fingerprints)
SELECT fn_id, coalesce(a.v, b.v) AS value FROM t LEFT JOIN r a ON a.p = 'crates/' || file LEFT JOIN r b ON b.p = file"""
)
def q_batch_lookup(spark, d):
    h = _t(spark, d, "hotspots").filter("file is not null and not isnan(responsibility)").select(F.col("file").alias("path"), F.col("responsibility").alias("value"))
    t = once(_t(spark, d, "fingerprints").select("fn_id", "file"), "fn_id").withColumn("canonical", F.concat(F.lit("crates/"), "file"))
    return semantic.batch_lookup(t, h, "value", path="file").select("fn_id", "value")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def q_visible_fields(spark, d):
    """Fields by the visibility their flag stands for: public, of the crate, or of the module."""
    flag = F.when(F.col("l_returnflag") == "A", "public").when(F.col("l_returnflag") == "R", "crate").otherwise("module")
    return semantic.visible_fields(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("visibility"))).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, round(sum(log2(l_linenumber)), 6) AS bits FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey HAVING sum(log2(l_linenumber)) > 0")
def q_resolved_functions(spark, d):
    b = _t(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "N", "tuple").otherwise("ident").alias("pattern"), F.col("l_linenumber").alias("states"))
    return semantic.resolved_functions(b, ["l_orderkey"]).select("l_orderkey", F.round("internal_state_cardinality_log2", 6).alias("bits"))


@query("SELECT fn_id FROM (SELECT DISTINCT fn_id, file FROM fingerprints) WHERE starts_with(file, 'crates/') OR file = 'crates'")
def q_subtree(spark, d):
    rows = once(_t(spark, d, "fingerprints").select("fn_id", F.col("file").alias("path")), "fn_id")
    return semantic.subtree(rows, "crates").select("fn_id")


@query(f"WITH {FN} SELECT 'bloat_function' AS cohort, count(*) AS n, CAST(sum(lines) AS DOUBLE) AS total FROM fn WHERE NOT is_test UNION ALL SELECT 'state_cardinality_function', count(*), sum(1 + bits) FROM fn WHERE NOT is_test AND bits > 0 UNION ALL SELECT 'code_economy', 1, round((count(*) FILTER (NOT is_test) + 7) / (count(*) FILTER (NOT is_test AND is_pub) + 3), 6) FROM fn")
def q_cohort_feed(spark, d):
    feed = corpora.cohort_feed(functions(spark, d), None, (), macros=7, exported=3)
    return feed.groupBy("cohort").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("cohort", "n", r6("total"))


@query(
    """WITH i AS (SELECT DISTINCT fn_id, name, file, line FROM fingerprints), h AS (SELECT DISTINCT hotspot_id, file, function_name AS name, line FROM hotspots WHERE file IS NOT NULL AND line IS NOT NULL),
o AS (SELECT name, line, replace(file, 'crates/', '') AS file, min(hotspot_id) AS value FROM h GROUP BY ALL),
f AS (SELECT fn_id, o.value AS w, row_number() OVER (PARTITION BY fn_id ORDER BY CASE WHEN i.file = o.file THEN 0 ELSE 1 END, o.file) AS n FROM i JOIN o ON i.name = o.name AND i.line = o.line AND (suffix(i.file, '/' || o.file) OR suffix(o.file, '/' || i.file) OR i.file = o.file))
SELECT i.fn_id, w AS value FROM i LEFT JOIN f ON i.fn_id = f.fn_id AND n = 1"""
)
def q_overlay_line(spark, d):
    """Lookup by name, line and path, as for resolved functions."""
    items = once(_t(spark, d, "fingerprints").select("fn_id", "name", "file", "line", F.lit("m").alias("module_path")), "fn_id")
    h = _t(spark, d, "hotspots").filter("file is not null and line is not null").select(F.col("function_name").alias("name"), "line", F.replace("file", F.lit("crates/"), F.lit("")).alias("file"), "hotspot_id", F.lit("m").alias("module_path"))
    h = h.groupBy("name", "line", "file", "module_path").agg(F.min("hotspot_id").alias("value"))
    return overlay.overlay_lookup(items, h, "value", equal=("name", "line")).select("fn_id", "value")


# ---- small functions over whole tables ----


@query("SELECT DISTINCT doc_id, CAST(1 + length(left(text, h)) - length(replace(left(text, h), chr(10), '')) AS BIGINT) AS line FROM (SELECT doc_id, text, length(text) // 2 AS h FROM documents WHERE text IS NOT NULL)")
def q_definition_line(spark, d):
    """The line in the middle of each text."""
    return docs(spark, d).select("doc_id", rust.definition_line(F.col("text"), F.floor(F.length("text") / 2).cast("int")).cast("bigint").alias("line"))


@query("SELECT hotspot_id, CASE WHEN starts_with(file, 'crates/') THEN file[8:] ELSE file END AS path FROM (SELECT DISTINCT hotspot_id, file FROM hotspots)")
def q_relative_path(spark, d):
    return once(_t(spark, d, "hotspots").select("hotspot_id", "file"), "hotspot_id").select("hotspot_id", rust.relative_path(F.col("file"), "crates").alias("path"))


@query(
    """WITH c AS (SELECT event_id, 'rgb:' || format('{:02x}', event_id % 256) || '/' || format('{:04x}', (event_id * 37) % 65536) || '/' || format('{:x}', event_id % 16) AS reply FROM events)
SELECT event_id, reply, CAST(event_id % 256 AS BIGINT) AS r, CAST(round(((event_id * 37) % 65536) * 255.0 / 65535) AS BIGINT) AS g, CAST((event_id % 16) * 17 AS BIGINT) AS b FROM c"""
)
def q_osc_colour(spark, d):
    hexed = lambda x, n: F.lower(F.lpad(F.hex(x), n, "0"))
    e = F.col("event_id")
    reply = F.concat(F.lit("rgb:"), hexed(e % 256, 2), F.lit("/"), hexed((e * 37) % 65536, 4), F.lit("/"), hexed(e % 16, 1))
    return _t(spark, d, "events").select("event_id", reply.alias("reply")).select("event_id", "reply", color.osc_colour(F.col("reply")).alias("c")).select("event_id", "reply", "c.r", "c.g", "c.b")


@query(
    """WITH h AS (SELECT event_id, CAST(event_id % 360 AS DOUBLE) AS h, CAST(user_id % 11 AS DOUBLE) / 10.3 AS s, CAST(event_id % 21 AS DOUBLE) / 20.7 AS l FROM events),
x AS (SELECT *, (1 - abs(2 * l - 1)) * s AS c, (1 - abs(2 * l - 1)) * s * (1 - abs((h / 60) % 2 - 1)) AS x, CAST(floor(h / 60) AS INT) AS k FROM h)
SELECT event_id, """
    + ", ".join(f"CAST(round((CASE k {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(z))} END + l - c / 2) * 255.0) AS BIGINT) AS {n}" for n, z in (("r", "cx00xc"), ("g", "xccx00"), ("b", "00xccx")))
    + " FROM x"
)
def q_hsl(spark, d):
    e = _t(spark, d, "events")
    hsl = color.hsl_to_rgb((F.col("event_id") % 360).cast("double"), (F.col("user_id") % 11).cast("double") / 10.3, (F.col("event_id") % 21).cast("double") / 20.7)
    return e.select("event_id", hsl.alias("c")).select("event_id", "c.r", "c.g", "c.b")


@query("SELECT event_id, 'user:' || user_id || '  ' || 'type:' || event_type AS hint FROM events")
def q_hint(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("action"))
    return _t(spark, d, "events").select("event_id", text.hint(F.array(pair("user", F.col("user_id").cast("string")), pair("type", F.col("event_type")))).alias("hint"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN user_id % 2 = 0 THEN event_type ELSE 'other' END AS action FROM events")
def q_first_match(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", matching.first_match((F.col("value") > 50, F.lit("high")), (F.col("user_id") % 2 == 0, F.col("event_type")), (F.lit(True), F.lit("other"))).alias("action"))


@query("SELECT p_partkey, lower(trim(p_brand)) AS language FROM part UNION ALL SELECT -n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' ELSE 'zig' END FROM nation")
def q_language(spark, d):
    parts = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("n"))
    names = F.element_at(F.array(F.lit("RS"), F.lit(" py "), F.lit("zig")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    more = _t(spark, d, "nation").select((-F.col("n_nationkey")).alias("p_partkey"), names.alias("n"))
    return parts.unionByName(more).select("p_partkey", text.language(F.col("n")).alias("language"))


@query("SELECT DISTINCT doc_id, left(text, 40) AS shown, CAST(length(text) AS BIGINT) AS width FROM documents WHERE text IS NOT NULL")
def q_clip(spark, d):
    """Texts clipped to 40 columns; those of these tables have no wide characters."""
    return docs(spark, d).select("doc_id", text.clip_width(F.left("text", F.lit(40)), 40).alias("shown"), text.display_width(F.col("text")).cast("bigint").alias("width"))


@query("SELECT user_id % 7 AS key, any_value(event_type) AS label FROM events WHERE user_id < 0 GROUP BY 1 UNION ALL SELECT event_id, event_type FROM events WHERE value > 10")
def q_hints(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("label"), (F.col("value") > 10).alias("guard"))
    return navigation.hints(rows)
