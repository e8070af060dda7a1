import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import aggregates, attribution, cohorts, coupling, diffs, duplicates, entropy, frames, matching, overlay, rollup
from tallyforge.policy import Aggregation, Policy, Strategy

POLICIES = [
    Aggregation(),
    Aggregation("arithmetic_mean_score"),
    Aggregation("power_mean_loss", p=2.0),
    Aggregation("power_mean_loss", p=0.5),
    Aggregation("mean_plus_cvar_loss", alpha=0.3, tail_weight=0.5),
    Aggregation("mean_plus_cvar_loss", alpha=1.0, tail_weight=0.2),
    *[Aggregation("hierarchical_file_weighted_mean_loss", size_weighting=w) for w in ("uniform", "linear", "sqrt", "log2")],
]


def weight(x, kind):
    x = max(x, 1.0)
    return {"uniform": 1.0, "linear": x, "sqrt": math.sqrt(x), "log2": max(math.log2(x), 1.0)}[kind]


def naive(items, policy):
    """items: (file, score, size). Everything aggregated anew."""
    s = [x[1] for x in items]
    n = len(s)
    clamp = lambda x: min(max(x, 0.0), 1.0)
    if policy.kind == "geometric_mean_score":
        return 0.0 if min(s) <= 0 else math.exp(sum(map(math.log, s)) / n)
    if policy.kind == "arithmetic_mean_score":
        return sum(s) / n
    if policy.kind == "power_mean_loss":
        p = max(policy.p, 1.0)
        return clamp(1 - (sum((1 - x) ** p for x in s) / n) ** (1 / p))
    if policy.kind == "mean_plus_cvar_loss":
        k = min(max(math.ceil(n * policy.alpha), 1), n)
        l = sorted((1 - x for x in s), reverse=True)  # noqa: E741
        return clamp(1 - (sum(l) / n + policy.tail_weight * sum(l[:k]) / k))
    files = {}
    for f, x, z in items:
        files.setdefault(f, []).append((1 - x, z))
    num = den = 0.0
    for v in files.values():
        w = [weight(z, policy.size_weighting) for _, z in v]
        outer = weight(sum(max(z, 1.0) for _, z in v), policy.size_weighting)
        num += outer * sum(a * b for (a, _), b in zip(v, w)) / sum(w)
        den += outer
    return clamp(1 - num / den)


def population(seed, n):
    rnd = random.Random(seed)
    return [(i, rnd.choice("abc"), rnd.choice([0.0, 1.0, 0.5, 0.5, rnd.random()] if seed % 2 else [1.0, 0.5, rnd.random()]), rnd.choice([0.0, 1.0, 7.0, 120.0])) for i in range(n)]


@pytest.fixture(scope="module")
def groups(spark):
    pops = {seed: population(seed, n) for seed, n in ((1, 12), (2, 30), (3, 1), (4, 2), (5, 40))}
    rows = [(g, *r) for g, p in pops.items() for r in p]
    return pops, spark.createDataFrame(rows, "g int, id int, file string, score double, size_hint double").cache()


@pytest.mark.parametrize("policy", POLICIES, ids=str)
def test_aggregation_and_counterfactuals_equal_recomputation(groups, policy):
    pops, df = groups
    got = {r["g"]: r["score"] for r in aggregates.aggregate_scores(df, ["g"], policy).collect()}
    cf = {(r["g"], r["id"]): (r["dimension_score"], r["cf"]) for r in attribution.counterfactual_scores(df, ["g"], policy).collect()}
    for g, p in pops.items():
        items = [(f, s, z) for _, f, s, z in p]
        whole = naive(items, policy)
        assert got[g] == pytest.approx(whole, abs=1e-9)
        for k, (i, f, s, z) in enumerate(p):
            again = naive([*items[:k], (f, 1.0, z), *items[k + 1 :]], policy)
            # a root amplifies rounding where hardly any loss is left
            assert cf[g, i] == pytest.approx((whole, again), abs=1e-7)


def test_golden_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 0.5, 1.0)], "file string, score double, size_hint double")
    assert aggregates.aggregate_scores(df, [], Aggregation()).first()["score"] == pytest.approx(0.70710678)
    h = spark.createDataFrame([("a", 0.2, 100.0), ("a", 0.8, 20.0), ("b", 0.9, 10.0)], "file string, score double, size_hint double")
    fa = (0.8 * 100 + 0.2 * 20) / 120
    want = 1 - (fa * 120 + 0.1 * 10) / 130
    assert aggregates.aggregate_scores(h, [], Aggregation("hierarchical_file_weighted_mean_loss", size_weighting="linear")).first()["score"] == pytest.approx(want)


def test_composite_and_shares(spark):
    others = spark.createDataFrame([(1, 0.5), (1, 0.8), (2, 0.0), (2, 0.9)], "g int, score double")
    dim = spark.createDataFrame([(1, 0.25), (2, 0.25)], "g int, score double")
    items = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "g int, name string")
    rest = attribution.composite_with(others, ["g"])
    got = {r["name"]: r["responsibility"] for r in attribution.equal_share_heatmap(items, ["g"], dim, rest).collect()}
    gain = (0.5 * 0.8) ** (1 / 3) - (0.5 * 0.8 * 0.25) ** (1 / 3)
    assert got == {"x": pytest.approx(gain / 2), "y": pytest.approx(gain / 2), "z": 0.0}
    lossy = spark.createDataFrame([(2, "a", 0.3, 1.0)], "g int, file string, score double, size_hint double")
    assert attribution.itemized_heatmap(lossy, ["g"], Aggregation(), rest).count() == 0  # another dimension is 0


def test_cohorts(spark):
    df = spark.createDataFrame([("c", float(x)) for x in (10, 20, 30, 40)] + [("c", float("nan")), ("c", None), ("d", 7.0)], "cohort string, v double")
    st = {r["cohort"]: r for r in cohorts.cohort_stats(df, ["cohort"], "v").collect()}
    assert (st["c"]["value_count"], st["c"]["mean"]) == (4, 25.0)
    assert st["c"]["stddev"] == pytest.approx(11.180339887498949) and st["d"]["stddev"] == 0.0
    assert [st["c"][q] for q in ("q25", "q50", "q75")] == [17.5, 25.0, 32.5]
    parts = cohorts.moments(df.withColumn("day", F.floor("v") % 3), ["day", "cohort"], "v")
    merged = {r["cohort"]: r for r in cohorts.merge_moments(parts, ["cohort"]).collect()}
    assert merged["c"]["stddev"] == pytest.approx(11.180339887498949) and merged["c"]["value_count"] == 4


@pytest.mark.parametrize(
    ("strategy", "want"),
    [
        (Strategy("cohort_mean_stddev", stddev_multiplier=1.0), 30 + math.sqrt(200)),
        (Strategy("cohort_mean", multiplier=2.0), 60.0),
        (Strategy("cohort_upper_quartile"), 40.0),
        (Strategy("cohort_median_iqr"), 30 + 20 / 1.349),
        (Strategy("cohort_mean", min_count=6), math.log2(45)),
        (Strategy("scaled_target_threshold", multiplier=2.0), 2 * math.log2(45)),
        (Strategy(), math.log2(45)),
    ],
)
def test_thresholds(spark, strategy, want):
    df = spark.createDataFrame([("bloat_function", float(x)) for x in (10, 20, 30, 40, 50)], "cohort string, raw double")
    out = cohorts.normalize(df, cohorts.cohort_stats(df, ["cohort"], "raw"), "bloat_function", Policy(normalization={"bloat_function": strategy}), ["cohort"])
    assert out.first()["threshold"] == pytest.approx(want)


def test_duplicates(spark):
    base = [f"t{i % 9}" for i in range(40)]
    rnd = random.Random(4)
    rows = [(1, base), (2, base), (3, [rnd.choice("abcdef") for _ in range(40)]), (4, ["x"]), (5, None)]
    rows += [(6, [*rows[2][1][:39], "q"])]
    df = spark.createDataFrame(rows, "fn_id long, shape array<string>")
    assert [tuple(r) for r in duplicates.exact_groups(df).collect()] == [(40, 2, 1)]
    assert [tuple(r)[:2] for r in duplicates.near_pairs(df).collect()] == [(3, 6)]
    assert duplicates.duplication_score(df).first()["duplication_score"] == pytest.approx(4 / 6)


EDGES = [("a", "b", "f"), ("b", "c", "g"), ("a", "a", "f"), ("a", "b", "f")]


def test_coupling(spark):
    rows = [(x, f"{x}.rs", y, f"{y}.rs", f, i) for i, (x, y, f) in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "caller_module string, caller_file string, callee_module string, callee_file string, caller_function string, caller_line long")
    d = coupling.density(df).first()
    assert (d["modules"], d["edges"], d["density"]) == (3, 2, pytest.approx(1 / 3))
    assert sorted(map(tuple, coupling.by_function(df).collect())) == [("a", "a::f", 1), ("b", "b::g", 1), ("c", "c", 0)]
    assert {r["module"]: r["file"] for r in coupling.first_file(df, "caller_line").collect()} == {"a": "a.rs", "b": "b.rs", "c": "c.rs"}
    assert coupling.density(df.limit(0)).first()["density"] == 0.0


def test_overlay(spark):
    items = spark.createDataFrame([("src/a.rs", "m", "X", 1.0), ("src/b.rs", "m", "Y", 2.0), ("z.rs", "m", "Z", 3.0)], "file string, module_path string, name string, own double")
    over = spark.createDataFrame([("src/a.rs", "m", "X", 9.0), ("w/src/b.rs", "q", "Y", 8.0), ("v/src/b.rs", "q", "Y", 7.0), ("xz.rs", "m", "Z", 6.0)], "file string, module_path string, name string, v double")
    got = {r["name"]: r["v"] for r in overlay.overlay_lookup(items, over, "v", default="own").collect()}
    assert got == {"X": 9.0, "Y": 7.0, "Z": 3.0}


def test_rollup(spark):
    seg = lambda *xs: [{"kind": k, "name": n} for k, n in xs]
    rows = [(seg(("module", "m"), ("function", "f")), "f", 0.3, "bloat", "a.rs", 1), (seg(("module", "m"), ("function", "g")), "g", 0.7, "bloat", "a.rs", 2), ([], "h", 0.5, "x", "b.rs", 3)]
    df = spark.createDataFrame(rows, "scope_path array<struct<kind:string,name:string>>, function_name string, responsibility double, dimension string, file string, line long")
    tree = rollup.rollup_tree(df)
    got = {r["k"]: r["responsibility"] for r in tree.select(rollup.key(F.col("path")).alias("k"), "responsibility").collect()}
    assert got == {"module:m": pytest.approx(1.0), "module:m/function:f": 0.3, "module:m/function:g": 0.7, "function:h": 0.5}
    order = [r["k"] for r in rollup.pre_order(tree).orderBy("ids").select(rollup.key(F.col("path")).alias("k")).collect()]
    assert order == ["module:m", "module:m/function:g", "module:m/function:f", "function:h"]
    assert rollup.with_root(tree).filter("depth = 0").first()["responsibility"] == pytest.approx(1.5)
    assert {r["k"] for r in rollup.visible(tree, []).select(rollup.key(F.col("path")).alias("k")).collect()} == {"module:m", "function:h"}
    hot = {r["k"]: r["function_name"] for r in rollup.hottest(df).select(rollup.key(F.col("path")).alias("k"), "function_name").collect()}
    assert hot["module:m"] == "g"
    rel = {r["k"]: r["relation"] for r in rollup.path_relations(tree, "module:m/function:f").select(rollup.key(F.col("path")).alias("k"), "relation").collect()}
    assert rel == {"module:m": "direct", "module:m/function:g": "on_route"}


def test_apportion_and_legend(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 1.0), ("z", "a", 0.0)], "g string, name string, v double")
    got = {(r["g"], r["name"]): r["cells"] for r in rollup.apportion(df, ["g"], "v", 10, ["name"]).collect()}
    assert got == {("g", "a"): 4, ("g", "b"): 3, ("g", "c"): 3, ("z", "a"): 0}
    rows = {r["label"]: r["types"] for r in rollup.legend(df, ["g"], "name", "v", 6, ["name"]).collect()}
    assert rows == {"a": 1, "b": 1, "+1 types": 1}


def test_diffs(spark):
    h = "file string, function_name string, dimension string, responsibility double"
    a = spark.createDataFrame([("f", "x", "d", 0.5), ("f", "x", "d", 0.2), ("f", "y", "d", 0.1), ("f", "z", "d", 0.3)], h)
    b = spark.createDataFrame([("f", "x", "d", 0.4), ("f", "z", "d", 0.3), ("f", "w", "d", 0.1)], h)
    got = {r["function_name"]: r["status"] for r in diffs.diff_heatmaps(a, b).collect()}
    assert got == {"x": "regressed", "y": "disappeared", "z": "unchanged", "w": "appeared"}
    d = "dimension string, score double"
    one, two = spark.createDataFrame([("p", 0.5), ("q", 0.5)], d), spark.createDataFrame([("p", 0.75)], d)
    with pytest.raises(Exception, match="q"):
        diffs.strict_loss_delta(one, two).collect()
    assert diffs.strict_loss_delta(one.filter("dimension = 'p'"), two).first()["delta"] == pytest.approx(-0.25)
    last = diffs.keep_last(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, o int, v string"), ["k"], F.col("o")).first()
    assert last["v"] == "b"


def test_entropy(spark):
    docs = spark.createDataFrame([(1, "a a a a"), (2, "a b c d e f g h"), (3, "")], "doc_id long, text string")
    e = {r["doc_id"]: r for r in entropy.entropy(entropy.token_counts(docs, ["doc_id"]), ["doc_id"]).collect()}
    assert (e[1]["entropy"], e[1]["vocabulary"]) == (0.0, 1)
    assert e[2]["entropy"] == pytest.approx(3.0) and e[2]["normalized"] == pytest.approx(1.0) and 3 not in e
    none = entropy.entropy(entropy.pooled(entropy.token_counts(docs.limit(0), ["doc_id"]))).first()
    assert (none["total"], none["entropy"]) == (0, 0.0)


def test_fuzzy(spark):
    df = spark.createDataFrame([(1, "open file"), (2, "of"), (3, "fo"), (4, "Open-File"), (5, "proof")], "id int, s string")
    got = {r["id"]: r["x"] for r in df.select("id", matching.fuzzy_score("of", F.col("s")).alias("x")).collect()}
    assert got == {1: 1 + 5 + 10 + 1 + 5, 2: 1 + 5 + 10 + 1 + 3, 3: None, 4: 22, 5: 1 + 1}
    assert [r["id"] for r in matching.fuzzy_rank(df, "", "s", "id").collect()] == [1, 2, 3, 4, 5]


def test_frames(spark):
    rows = [("s", 1, [0.0, 0.0]), ("s", 2, [1.0, 0.0]), ("s", 3, [1.0, 0.0]), ("s", 4, [4.0, 0.0])]
    df = spark.createDataFrame(rows, "series string, frame int, cells array<double>")
    d = frames.frame_deltas(df, "series", "frame", "cells")
    assert [tuple(r)[1:] for r in d.orderBy("frame").collect()] == [(2, 1, 1.0, 1.0), (3, 0, 0.0, 0.0), (4, 1, 3.0, 3.0)]
    assert frames.smoothness(d, "series").first()["smoothness"] == pytest.approx(0.5)
    assert frames.coverage(df, "series", "frame", "cells").first()["coverage"] == 0.5
    assert frames.periodicity(df, "series", "frame", "cells").first()["distance"] == 2.0


def test_details_fallbacks_and_screens(spark):
    from tallyforge.functions import color
    from tallyforge.plans import dimensions
    from tallyforge.sources import reports

    exact = spark.createDataFrame([(1, 1), (2, 1)], "fn_id long, first long")
    near = spark.createDataFrame([(2, 5, 0.9)], "a long, b long, similarity double")
    assert {tuple(r) for r in duplicates.details(exact, near).collect()} == {(1, "same as 1"), (2, "same as 1; near 5"), (5, "near 2")}
    snaps = spark.createDataFrame([("x",), ("y",)], "label string")
    saved = spark.createDataFrame([("x", 0.3)], "label string, density double")
    assert {r["label"]: r["score"] for r in dimensions.coupling_fallback(saved, snaps, ["label"]).collect()} == {"x": pytest.approx(0.7), "y": 1.0}
    one = spark.createDataFrame([("rgb:ffff/0000/80", "a\nb", "a\nc")], "r string, a string, b string")
    got = one.select(color.osc_colour(F.col("r")).alias("c"), color.osc_colour(F.lit("none")).alias("n"), reports.text_diff(F.col("a"), F.col("b")).alias("d")).first()
    assert tuple(got["c"]) == (255, 0, 128) and got["n"] is None and "-b" in got["d"] and "+c" in got["d"]
    cells = spark.createDataFrame([("f", 0, 1, "b", 3), ("f", 0, 0, "a", 3), ("f", 0, 2, " ", 9)], "frame string, y int, x int, symbol string, fg int")
    assert frames.buffer_text(cells, "frame", "y", "x", "symbol").first()["line"] == "ab"
    assert [r["fg"] for r in frames.palette(cells).collect()] == [3]
    dim, others = spark.createDataFrame([(0.25,)], "score double"), attribution.composite_with(spark.createDataFrame([(1.0,)], "score double"), [])
    assert attribution.whole_share(dim, others, "coupling_density").first()["responsibility"] == pytest.approx(0.5)
    assert attribution.whole_share(spark.createDataFrame([(1.0,)], "score double"), others, "coupling_density").count() == 0
