import math

import pytest

from tallyforge.operators import duplicates
from tallyforge.plans import corpus, dimensions, snapshot
from tallyforge.plans.queries import QUERIES
from tallyforge.policy import Policy


def _mean(dims, **other):
    out = 1.0
    for v in (dims | other).values():
        out *= v
    return out ** (1 / len(dims))


def test_all_five_dimensions_are_attributed(spark, tmp_path):
    body = "    let mut a = true;\n    if a { b(); }\n    c(a);\n" * 30
    (tmp_path / "lib.rs").write_text(f"pub fn long() {{\n{body}}}\nstruct Flags {{ a: bool, b: bool, c: bool, d: bool, e: bool }}\nmacro_rules! m {{ () => {{ if x {{}} }} }}\nmacro_rules! n {{ () => {{ loop {{}} }} }}\n")
    (tmp_path / "two.rs").write_text("fn one() {\n    f(1); g(2); h(3)\n}\nfn two() {\n    f(1); g(2); h(3)\n}\n")
    report = snapshot.analyze(spark, str(tmp_path), saved=spark.createDataFrame([(0.25,)], "density double"))
    dims = {r["dimension"]: r["score"] for r in report.scored.dimensions.collect()}
    assert dims["coupling_density"] == 0.75 and dims["code_economy"] < 1
    heat = report.heatmap.collect()
    assert {r["dimension"] for r in heat} == set(dims)
    here = _mean(dims)
    of = lambda d: {r["function_name"]: r["responsibility"] for r in heat if r["dimension"] == d}
    share = (_mean(dims, duplication=1.0) - here) / 2
    assert of("duplication") == {"one": pytest.approx(share), "two": pytest.approx(share)}
    share = (_mean(dims, code_economy=1.0) - here) / 4
    assert of("code_economy") == {"one": pytest.approx(share), "two": pytest.approx(share), "<macro_rules>": pytest.approx(2 * share)}
    assert of("coupling_density") == {"coupling_density": pytest.approx(_mean(dims, coupling_density=1.0) - here)}
    assert {r["file"] for r in heat if r["line"] == 0} == {"<codebase>"} and all(r["detail"] for r in heat)


def test_corpus_run_measures_duplication_and_coupling_by_label(spark):
    long = [f"t{i % 9}" for i in range(40)]
    near = [*[f"u{i}" for i in range(40)]]
    shapes = [("a", 1, long), ("a", 2, long), ("a", 3, near), ("b", 4, long), ("b", 5, [*near[:39], "q"]), ("b", 6, ["x"] * 7), ("c", 7, near), ("c", 8, [*near[:39], "q"])]
    fp = spark.createDataFrame([(x, i, f"f{i}", f"{x}.rs", i, s) for x, i, s in shapes], "label string, fn_id long, name string, file string, line long, shape array<string>")
    got = {r["label"]: (r["fingerprinted"], r["exact"], r["near"]) for r in duplicates.duplication_score(fp, by=["label"]).collect()}
    assert got == {"a": (3, 2, 0), "b": (3, 0, 0), "c": (2, 0, 2)}
    fn = spark.createDataFrame([(x, f"f{i}", f"{x}.rs", i, 60, False, i % 2 == 0) for x, i, _ in shapes], "label string, name string, file string, line long, lines long, is_test boolean, is_pub boolean")
    edges = spark.createDataFrame([("a", "m", "n", "f1"), ("a", "m", "o", "f1"), ("c", "m", "m", "f7")], "label string, caller_module string, callee_module string, caller_function string")
    saved = spark.createDataFrame([("b", 0.25)], "label string, density double")
    obs = dimensions.bloat(fn, ["label"]).unionByName(dimensions.economy(fn, ["label"]))
    feed = fn.selectExpr("label", "'bloat_function' AS cohort", "CAST(lines AS DOUBLE) AS value")
    scored, heat = corpus.run(obs, feed, Policy(), fingerprints=fp, edges=edges, overhead=dimensions.overhead_rows(fn, ["label"]), saved=saved)
    dims = {(r["label"], r["dimension"]): r["score"] for r in scored.dimensions.collect()}
    assert [dims[x, "duplication"] for x in "abc"] == [pytest.approx(1 / 3), 1.0, 0.0]
    assert [dims[x, "coupling_density"] for x in "abc"] == [pytest.approx(2 ** (-2 / 9)), 0.75, 1.0]
    rows = heat.collect()
    assert {(r["label"], r["function_name"]) for r in rows if r["dimension"] == "duplication"} == {("a", "f1"), ("a", "f2"), ("c", "f7"), ("c", "f8")}
    assert {(r["label"], r["function_name"]) for r in rows if r["dimension"] == "coupling_density"} == {("a", "m::f1"), ("b", "coupling_density")}


def test_normalization_queries_take_all_five_cohorts(spark, tmp_path):
    targets = {"code_economy": 5, "state_cardinality_type": 4, "state_cardinality_function": 4, "bloat_function": 45, "coupling_module": 3}
    rows = [(10 * i + j, c, float(x)) for i, c in enumerate(targets) for j, x in enumerate((1, 2, 3, 4, 10 * (i + 1)))]
    rows += [(99, "other", 1.0), (98, "bloat_function", float("nan"))]
    cols = "'l' AS label, 'd' AS dimension, 'k' AS kind, 'f' AS file, 1L AS line, 'n' AS name, 1.0D AS size_hint, 0.0D AS normalized, 0.0D AS calibrated_score, '' AS detail"
    df = spark.createDataFrame(rows, "obs_id long, cohort string, raw double").selectExpr("*", *cols.split(", ")).selectExpr("*", "CAST(array() AS array<struct<kind:string,name:string>>) AS scope_path")
    df.write.parquet(str(tmp_path / "observations.parquet"))
    got = {r["obs_id"]: r["normalized"] for r in QUERIES["q_norm_all_mean"](spark, str(tmp_path)).collect()}
    assert got == {n: pytest.approx(x / (1.5 * (10 + 10 * (n // 10 + 1)) / 5), rel=1e-6) for n, _, x in rows[:-2]}
    got = {r["obs_id"]: r["normalized"] for r in QUERIES["q_norm_all_fallback"](spark, str(tmp_path)).collect()}
    own = [math.log2(5), 4.0, 4.0, math.log2(45), 3.0]
    assert got == {n: pytest.approx(x / own[n // 10], rel=1e-6) for n, _, x in rows[:-2]}
