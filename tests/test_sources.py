import json
import signal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.plans import snapshot
from tallyforge.policy import Policy
from tallyforge.sources import reports, rust
from tallyforge.sources.rust_measure import measure_file, resolved_states
from tallyforge.sources.rust_syntax import RustSyntaxError, lex


def fn(src, name=None):
    found = measure_file(src, "x.rs")["functions"]
    return found[0] if name is None else next(f for f in found if f["name"] == name)


def ty(src):
    return measure_file(src, "x.rs")["types"][0]


@pytest.mark.parametrize(
    ("src", "states"),
    [
        ("struct S { a: bool, b: bool, c: bool }", 8),
        ("enum E { A, B(bool) }", 2),
        ("struct S { a: Option<bool> }", 3),
        ("struct S { a: Option<Option<bool>> }", 4),
        ("struct S { a: Result<bool, Option<u8>> }", 4),
        ("struct S { a: (bool, &'static bool), b: Vec<bool>, c: std::option::Option<bool> }", 4),
        ("struct S<T> where T: Clone { pub(crate) a: Option<T>, b: [bool; 4] }", 2),
    ],
)
def test_states(src, states):
    assert ty(src)["state_cardinality"] == states


def test_tuple_structs_are_no_rows_and_enums_count_variants():
    assert measure_file("struct A(bool); struct B;", "x.rs")["types"] == []
    t = ty("enum E { A { x: bool, y: Option<u8> }, B, C = 3 }")
    assert (t["total_fields"], t["bool_fields"], t["option_fields"]) == (3, 1, 1)


def test_resolved_states_add_up_variants_and_stop_at_cycles():
    local = {"E": ("enum", [[], [("path", 1, "bool", [])]]), "S": ("struct", [("path", 1, "E", []), ("path", 1, "S", [])])}
    assert resolved_states(("path", 1, "S", []), local) == 3


def test_control_flow():
    src = """fn f(x: i32, y: &mut Vec<Vec<u8>>) -> bool {
        if x > 0 && x < 9 { for i in 0..x { while true { } } } else if x == -1 { loop { break; } }
        match x { 0 => {} 1 | 2 => (), n if n > 3 => {} _ => {} }
        let c = |v: i32| v + 1;
        g(x)?;
        true
    }"""
    f = fn(src)
    assert (f["params"], f["nesting_depth"], f["cyclomatic"]) == (2, 3, 1 + 1 + 1 + 1 + 1 + 1 + 1 + 3 + 1)


def test_shape():
    shape = lambda body: measure_file(f"fn f() {{ {body} }}", "x.rs")["fingerprints"][0]["shape"]
    assert shape("let mut a = 1; a += b.c[0]; return &a;") == ["LetMut", "Literal", "BinOp", "FieldAccess", "IndexAccess", "Literal"][:3] + ["IndexAccess", "FieldAccess", "Literal", "Return", "Reference"]
    assert shape("if a { x() } else { y.z() }") == ["If", "Call", "Else", "Block", "Call"]
    assert shape("println!(); let v = vec![1];") == ["Let", "Macro"]
    assert shape("a = S { x: 1, ..d }; f(async { 1 }.await)") == ["Assign", "Literal", "Call", "Await", "Literal"]
    assert shape("x < y; Vec::<u8>::new(); (a as u8) < 3; !b; -1") == ["BinOp", "Call", "BinOp", "Literal", "UnaryOp", "UnaryOp", "Literal"]


def test_mutable_bindings_and_states():
    f = fn("fn f() { let mut a = true; let mut b = None; let (mut c, d) = (1, 2); let mut e: bool = false; let Some(mut g) = h else { return; }; }")
    assert (f["mutable_bindings"], f["internal_state_cardinality_log2"]) == (4, 2.0)


def test_assertions():
    f = fn("fn f() { assert!(true); assert_eq!(a, 1); std::debug_assert!(x.y); ensure!((z)); bail!(\"no\"); other!(a); }")
    assert (f["assertions"], f["meaningful_assertions"]) == (5, 3)


def test_visibility_scopes_and_tests():
    src = """pub mod a { pub struct Tt; impl Tt { pub fn m(&self) {} fn n(self: Box<Self>) {} } pub(crate) fn h() {} pub fn g() { fn inner() {} } }
    mod p { pub fn q() {} } trait R { fn s(&self) {} fn t(); } impl R for Long { fn s(&self) {} } impl<T> R for T { fn s(&self) {} }
    #[cfg(test)] mod tests { #[test] fn x() {} fn y() {} } #[tokio::test] async fn z() {} #[cfg(all(test, unix))] fn w() {}"""
    rows = {f["name"] + str(f["line"]): f for f in measure_file(src, "x.rs")["functions"]}
    got = {f["name"]: (f["is_pub"], f["is_test"]) for f in measure_file(src, "x.rs")["functions"] if f["name"] != "s"}
    assert got == {"m": (True, False), "n": (False, False), "h": (False, False), "g": (True, False), "inner": (False, False), "q": (False, False), "x": (False, True), "y": (False, True), "z": (False, False), "w": (False, False)}
    m = rows["m1"]
    assert m["module_path"] == "a" and [x["name"] for x in m["scope_path"]] == ["a", "Tt", "m"]
    owners = [[x["name"] for x in f["scope_path"]] for f in measure_file(src, "x.rs")["functions"] if f["name"] == "s"]
    assert owners == [["R", "s"], ["Long", "s"], ["s"]]


def test_macros_lines_and_odd_tokens():
    src = "#![allow(x)]\n#[macro_export]\nmacro_rules! a { () => { if x {} } }\nmacro_rules! b { () => { loop {} } }\nmacro_rules! c { () => { 1 } }\n"
    got = measure_file(src, "x.rs")
    assert (got["macros"], got["exported"]) == (1, 1)
    f = fn("fn f<'a>() {\n    // note\n\n    let s = r#\"}\"#; /* { /* nested */ */\n    let c = '{'; let l: &'a str = \"\\\"}\";\n    1.0e-3; 1..2; 0x1f; b'x';\n}\n")
    assert f["lines"] == 4
    for bad in ("fn f( {", "fn f() { let = ; ) }", "struct", '"open'):
        with pytest.raises((RustSyntaxError, IndexError)):
            measure_file(bad, "x.rs")
    assert [t.kind for t in lex("'a 'b'")] == ["life", "char"]


@pytest.fixture
def soon():
    """An endless loop is a failure here, not a test run without end."""

    def late(*_):
        raise TimeoutError("no end in sight")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, 3)
    yield
    signal.setitimer(signal.ITIMER_REAL, 0)
    signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize(
    "src",
    [
        "impl Foo;",
        "mod m { fn a() {} impl Foo for Bar }",
        "fn f() { g(|a) }",
        "fn f() { g(|a: u8, b) }",
        "fn f() { if x { |a } }",
        "fn f() { move move }",
        "fn f() { x as unsafe }",
        "fn f() { let a: extern = 1; }",
        "fn f() { let a: (fn) = 1; }",
        "fn f() { let a: (foo!) = 1; }",
        "fn f() { g(); match x }",
        "mod m { fn a() {} fn b }",
        "mod m { fn a() {} macro_rules! x }",
        "fn f() { g(); { fn } }",
    ],
)
def test_what_breaks_off_is_an_error_and_ends(soon, src):
    with pytest.raises(RustSyntaxError):
        measure_file(src, "x.rs")
    good = "fn f() {}"
    rows = next(rust._measure(iter([pd.DataFrame({"path": ["a", "b", "c"], "content": [good, src, good]})])))
    assert [bool(e) for e in rows["error"]] == [False, True, False] and [len(f) for f in rows["functions"]] == [1, 0, 1]


def test_the_whole_forms_still_parse(soon):
    src = """fn f(p: unsafe extern "C" fn(u8) -> bool) { g(|a| a, |a: u8, b| b, || 1, move || 2, async move |a| a); let q: (fn(u8), foo!(x)) = r; match x {} x as fn(u8); }
    macro_rules! x { () => {} } impl<T> Foo for Bar<T> where T: Baz { fn b(&self) {} }"""
    got = measure_file(src, "x.rs")
    assert [(f["name"], f["params"], f["nesting_depth"]) for f in got["functions"]] == [("f", 1, 1), ("b", 0, 0)]
    assert got["fingerprints"][0]["shape"].count("Closure") == 5


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    (d / "m").mkdir()
    body = "    let mut a = true;\n    if a { b(); }\n    c(a);\n    d(a);\n    e(a)?;\n" * 12
    (d / "lib.rs").write_text(f"pub fn long() {{\n{body}}}\npub fn short() {{ x(); }}\nstruct Flags {{ a: bool, b: bool, c: bool, d: bool, e: bool }}\n")
    (d / "m" / "two.rs").write_text("fn one() {\n    f(1); g(2); h(3)\n}\nfn two() {\n    f(1); g(2); h(3)\n}\n")
    (d / "bad.rs").write_text("fn broken( {\n// c\nx\n")
    (d / "note.txt").write_text("fn no() {}")
    return str(d)


def test_snapshot_of_a_tree(spark, tree):
    report = snapshot.analyze(spark, tree)
    names = {r["name"] for r in report.source.functions.collect()}
    assert names == {"long", "short", "one", "two"}
    files = {r["path"].rsplit("/", 1)[1]: r for r in report.source.files.collect()}
    assert set(files) == {"lib.rs", "two.rs", "bad.rs"} and files["bad.rs"]["error"] and files["bad.rs"]["total_lines"] == 2
    s = report.summary.first()
    assert (s["total_functions"], s["total_types"], s["total_bool_fields"], s["duplication_score"]) == (4, 1, 5, 0.5)
    dims = {r["dimension"]: r["score"] for r in report.scored.dimensions.collect()}
    assert dims["duplication"] == 0.5 and dims["coupling_density"] == 1.0 and 0 < dims["bloat"] < 1
    heat = report.heatmap.collect()
    top = max((r for r in heat if r["dimension"] == "bloat"), key=lambda r: r["responsibility"])
    assert top["function_name"] == "long" and top["responsibility"] > 0
    comp = report.scored.composite.first()["score"]
    prod = 1.0
    for v in dims.values():
        prod *= v
    assert comp == pytest.approx(prod ** (1 / 5))
    assert report.entropy_total.first()["vocabulary"] > 10
    doc = json.loads(reports.heatmap_summary(report.heatmap, report.scored.dimensions, report.scored.composite).first()["value"])
    assert doc["composite_loss"] == pytest.approx(1 - comp) and len(doc["dimensions"]) == 5
    lines = [r["line"] for r in reports.flat_lines(report.heatmap).collect()]
    assert any("long" in x for x in lines)


def test_semantic_overlay(spark, tree, tmp_path):
    p = tmp_path / "semantic.json"
    p.write_text(json.dumps({"type_cardinalities": [{"file": "lib.rs", "module_path": "", "name": "Flags", "cardinality_log2": 9.0}], "call_edges": [{"caller_module": "a", "caller_file": "a.rs", "callee_module": "b", "callee_file": "b.rs", "caller_function": "f", "caller_line": 1}]}))
    sem = reports.read_semantic(spark, str(p))
    assert sem["function_cardinalities"].count() == 0
    report = snapshot.analyze(spark, tree, Policy(), sem)
    obs = {(r["dimension"], r["name"]): r["raw"] for r in report.scored.observations.collect()}
    assert obs["state_cardinality", "Flags"] == 9.0
    assert obs["coupling_density", "a::f"] == 1.0 and obs["coupling_density", "b"] == 0.0


def test_rows_round_trip_and_text(spark, tmp_path):
    rows = spark.createDataFrame([("a.rs", 1, "f", "bloat", 0.5, "9 lines", [])], "file string, line long, function_name string, dimension string, responsibility double, detail string, scope_path array<struct<kind:string,name:string>>")
    reports.write_rows(rows, str(tmp_path / "h"))
    assert reports.read_rows(spark, str(tmp_path / "h"), "heatmap").collect() == rows.collect()
    assert reports.wrap("aa bb cc dd", 6, "  ") == ["aa bb", "  cc", "  dd"]
    assert reports.catalog(spark).count() == 5
    assert json.loads(reports.policy_json(Policy()))["aggregation"]["objective_scalarization"]["kind"] == "geometric_mean_score"
    both = reports.with_label({"x": rows, "y": rows})
    assert {r["file"] for r in both.collect()} == {"x/a.rs", "y/a.rs"}
    src = spark.createDataFrame([("a.rs", "l1\nl2\n")], "path string, content string")
    assert [tuple(r) for r in reports.snippet(src, "a.rs").collect()] == [(1, "l1"), (2, "l2")]
    assert src.select(rust.definition_line(F.col("content"), F.lit(4)).alias("n")).first()["n"] == 2
