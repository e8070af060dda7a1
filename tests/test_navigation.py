import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import cohorts, coupling, navigation, orders, overlay, rollup
from tallyforge.operators.delivery import numbered
from tallyforge.sources import reports, semantic


def tree(spark):
    seg = lambda *names: [("module", n) for n in names]
    rows = [(seg("a", "x"), 2.0), (seg("a", "y"), 1.0), (seg("b", "z"), 5.0), (seg("c"), 0.5)]
    df = spark.createDataFrame(rows, "scope_path array<struct<kind:string,name:string>>, responsibility double")
    return rollup.rollup_tree(df.withColumn("function_name", F.lit("f")).withColumn("dimension", F.lit("d")))


def test_tree_navigation(spark):
    t = tree(spark)
    assert {r["key"]: (r["parent"], r["has_children"]) for r in navigation.cache(t).collect()} == {
        "module:a": (None, True), "module:b": (None, True), "module:c": (None, False), "module:a/module:x": ("module:a", False), "module:a/module:y": ("module:a", False), "module:b/module:z": ("module:b", False)
    }
    assert {r["key"]: r["trail"] for r in navigation.trail(t).collect()}["module:a/module:y"] == ["inner", "last"]
    assert {r["key"]: r["trail"] for r in navigation.relation_trail(t, "module:a/module:y").collect()} == {"module:a/module:x": ["direct"], "module:a/module:y": ["direct"], "module:b/module:z": ["on_route"]}
    assert tuple(navigation.violations(t).first()) == (6, 0, 0, 0, 0)
    broken = t.filter(rollup.key(F.col("path")) != "module:b").unionByName(t.limit(1))
    assert navigation.violations(broken).first()["orphans"] == 1 and navigation.violations(broken).first()["repeated"] == 1
    assert navigation.find(t, "module:b").count() == 1 and navigation.find(t, "nothing").count() == 0


def test_numbering(spark):
    df = spark.range(200).selectExpr("id", "id % 7 as k", "cast(null as int) as n").repartition(5)
    got = {r["id"]: r["position"] for r in numbered(df, [F.col("k").desc(), "id"]).collect()}
    assert got == {i: p + 1 for p, i in enumerate(sorted(range(200), key=lambda i: (-(i % 7), i)))}
    assert numbered(df.limit(0), ["id"]).count() == 0


def test_orders_are_columns():
    assert [len(x) for x in (orders.entropy_order(), orders.group_order(), orders.pair_order(), orders.place_order("k"), orders.change_order(["k"]), orders.vector_order())] == [2, 2, 4, 4, 2, 1]


def test_quantiles_of_ties_nulls_and_small_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 5.0), *[("b", 2.0)] * 50, *[("b", float(i)) for i in range(50)], ("c", float("nan")), ("c", None)]
    got = {r["g"]: (r["q0"], r["q1"]) for r in cohorts.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.25, 0.5]).collect()}
    b = sorted([2.0] * 50 + [float(i) for i in range(50)])
    at = lambda p: b[int(p * 99)] + (b[int(p * 99) + 1] - b[int(p * 99)]) * (p * 99 - int(p * 99))
    assert got == {None: (1.5, 2.0), "a": (5.0, 5.0), "b": (pytest.approx(at(0.25)), pytest.approx(at(0.5)))}
    stats = cohorts.cohort_stats(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    assert {r["g"]: r["value_count"] for r in stats.collect()} == {None: 2, "a": 1, "b": 100}


def test_coupling_rows_with_and_without_functions(spark):
    schema = "caller_module string, caller_file string, callee_module string, callee_file string, caller_function string, caller_line long"
    rows = [("a", "a.rs", "b", "b.rs", "f", 1), ("a", "a.rs", "c", "c.rs", "f", 1), ("a", "a.rs", "b", "b.rs", "f", 9), ("a", "a.rs", "a", "a.rs", "g", 3)]
    got = sorted((r["module"], r["function"] or "", r["line"], r["file"], r["outgoing"]) for r in coupling.function_rows(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", "f", 1, "a.rs", 2), ("a", "f", 9, "a.rs", 1), ("b", "", 0, "b.rs", 0), ("c", "", 0, "c.rs", 0)]
    bare = spark.createDataFrame([(*r[:4], "", 0) for r in rows], schema)
    assert sorted((r["module"], r["outgoing"]) for r in coupling.function_rows(bare).collect()) == [("a", 2), ("b", 0), ("c", 0)]


def test_overlay_tails(spark):
    items = spark.createDataFrame([(1, "n", "src/a/mod.rs", "m"), (2, "n", "mod.rs", "m"), (3, "n", None, "m"), (4, "n", "x/amod.rs", "m"), (4, "n", "x/amod.rs", "m")], "id int, name string, file string, module_path string")
    over = spark.createDataFrame([("n", "a/mod.rs", "z", 10), ("n", "b/mod.rs", "z", 20), ("n", "", "z", 30)], "name string, file string, module_path string, v int")
    got = sorted((r["id"], r["v"]) for r in overlay.overlay_lookup(items, over, "v").collect())
    assert got == [(1, 10), (2, 10), (3, None), (4, None), (4, None)]
    assert {r["id"]: r["v"] for r in overlay.overlay_lookup(items, over, "v").collect()} == {1: 10, 2: 10, 3: None, 4: None}


def test_semantic_relations(spark, tmp_path):
    b = spark.createDataFrame([("f", "ident", 4), ("f", "ident", 2), ("f", "tuple", 8), ("g", "ident", 1)], "name string, pattern string, states long")
    assert [tuple(r) for r in semantic.resolved_functions(b, ["name"]).collect()] == [("f", 3.0)]
    fields = spark.createDataFrame([("a", "public"), ("b", "module"), ("c", None)], "name string, visibility string")
    assert [r["name"] for r in semantic.visible_fields(fields).collect()] == ["a"]
    with pytest.raises(ValueError):
        semantic.select_source(spark)
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "Cargo.toml").write_text("[workspace]\n")
    (tmp_path / "x.rs").write_text("")
    assert semantic.workspace_root(str(tmp_path / "deep/er")) == str(tmp_path)
    assert semantic.resolve_path("x.rs", str(tmp_path / "deep/er")) == str(tmp_path / "x.rs")
    assert semantic.resolve_path("/abs", ".") == "/abs" and semantic.resolve_path("no-such-file-here", str(tmp_path)) is None


def test_widths_and_languages(spark):
    df = spark.createDataFrame([("日本語", "RS"), ("a日b", "zig"), ("", None)], "t string, l string")
    got = [tuple(r) for r in df.select(text.display_width(F.col("t")), text.clip_width(F.col("t"), 3), text.language(F.col("l"))).collect()]
    assert got == [(6, "日", "rust"), (4, "a日", "zig"), (0, "", None)]


def test_a_report_round_trips(spark, tmp_path):
    from tallyforge.plans.snapshot import analyze

    (tmp_path / "src").mkdir()
    (tmp_path / "src/lib.rs").write_text("pub fn one(a: u32) -> u32 {\n    let mut x = a;\n    x += 1;\n    x\n}\nfn two() -> bool {\n    true\n}\n")
    report = analyze(spark, str(tmp_path / "src"))
    reports.save(report, str(tmp_path / "out"))
    again = reports.load(spark, str(tmp_path / "out"))
    assert again.summary.first() == report.summary.first()
    assert reports.compare(report, again)["summary"].filter("assessment <> 'unchanged'").count() == 0
    assert report.summary.first()["production_lines"] == 8
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/lib.rs").write_text("fn broken( {{{")
    with pytest.raises(ValueError):
        analyze(spark, str(tmp_path / "bad"))
