import math

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import color, scores as s, sets, text
from tallyforge.policy import Calibrator, Policy


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def val(one, c):
    return one.select(c.alias("x")).first()["x"]


def test_calibrators(one):
    assert val(one, s.capped_reciprocal(F.lit(2.0))) == 0.5
    assert val(one, s.linear_decay(F.lit(1.5), 2.0)) == 0.5
    assert val(one, s.exponential_decay(F.lit(1.0), 1.0)) == pytest.approx(0.5)
    for shape in (1.0, 2.0, 3.0):
        assert val(one, s.stretched_decay(F.lit(3.0), 3.0, shape)) == pytest.approx(0.5)
    assert math.isnan(val(one, s.clamp01(F.lit(float("nan")))))
    assert val(one, s.exponential_decay(F.lit(-5.0), 1.0)) == 1.0
    assert val(one, s.exponential_decay(F.lit(1.0), 0.0)) == 0.0


def test_state_score_table(one):
    c = Policy().calibrator("state_cardinality_type")
    got = [val(one, c.score(s.ratio_normalize(F.lit(float(b)), F.lit(4.0)))) for b in range(7)]
    assert [round(g, 3) for g in got] == [1.0, 0.958, 0.841, 0.677, 0.5, 0.339, 0.21]


def test_raw_and_guards(one):
    assert val(one, s.bloat_raw(F.lit(0))) == 0.0
    assert val(one, s.ratio_normalize(F.lit(5.0), F.lit(0.0))) == 0.0
    assert val(one, s.overhead_ratio(F.lit(5), F.lit(0), F.lit(0), F.lit(0))) == 0.0
    assert val(one, s.saturating_product(F.lit(2**62), F.lit(4))) == 2**63 - 1
    assert val(one, s.size_weight(F.lit(0), "log2")) == 1.0
    with pytest.raises(ValueError):
        s.size_weight(F.lit(1), "cubic")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("src/a.rs", "src/a.rs", True), ("crate/src/a.rs", "src/a.rs", True), ("src/a.rs", "crate/src/a.rs", True), ("xsrc/a.rs", "src/a.rs", False), ("a.rs", "b.rs", False), ("src/ba.rs", "a.rs", False), ("a.rs", "src/a.rs", True)],
)
def test_suffix_match(one, a, b, want):
    assert val(one, s.paths_suffix_match(F.lit(a), F.lit(b))) is want


def test_assessments(one):
    a = lambda d, h: val(one, s.assess_delta(F.lit(d), F.lit(h)))
    assert [a(0.0, True), a(1.0, True), a(1.0, False), a(-1.0, True), a(float("nan"), True)] == ["unchanged", "improved", "regressed", "regressed", "unchanged"]
    l = lambda d: val(one, s.assess_loss_delta(F.lit(d)))  # noqa: E731, E741
    assert [l(1e-11), l(-0.1), l(0.1)] == ["unchanged", "improved", "regressed"]


def test_sets(one):
    abc = F.array(*[F.lit(x) for x in "abcabc"])
    assert len(val(one, sets.ngrams(abc, 3))) == 3
    assert val(one, sets.ngrams(F.array(F.lit("a")), 3)) == []
    assert len(val(one, sets.run_hashes(abc, 3))) == 3
    assert val(one, sets.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert val(one, sets.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0.0


CODE = "fn a() {\n\n    // note\n    x(); /* open\n    y();\n/* block\n z\n*/ w();\n/* one */ v();\n/* two */ // no\n}\n"


def test_text(one):
    assert val(one, text.tokens(F.lit('let x="a b"; y+=1'))) == ["let", "x", "=", '"a', 'b"', ";", "y", "+", "=", "1"]
    assert val(one, text.code_lines(F.lit(CODE))) == 6
    assert val(one, text.code_lines(F.lit(""))) == 0
    assert val(one, text.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert val(one, text.ellipsize(F.lit("abcdef"), 4)) == "abc…"
    assert val(one, text.clock(F.lit(3725))) == "~1:02:05"
    assert val(one, text.clock(F.lit(65))) == "~1:05"
    assert val(one, text.compact_duration(F.lit(125))) == "2m 5s"
    assert val(one, text.fit(F.lit("> "), F.lit("abcdefgh"), F.lit(" 12"), 10)) == "> abcd… 12"
    assert val(one, text.hint(F.array(F.struct(F.lit("q").alias("key"), F.lit("quit").alias("action"))))) == "q:quit"


def test_python_and_column_code_lines_agree(one):
    from tallyforge.sources.rust_measure import code_lines

    for t in (CODE, "", "a", "/* x */ y", "/* x", "// z\n\n", "x /* y\nz */"):
        assert val(one, text.code_lines(F.lit(t))) == code_lines(t)


def test_colours(one):
    black, white = F.lit(0.0), F.lit(255.0)
    assert val(one, color.contrast_ratio(color.relative_luminance(white, white, white), color.relative_luminance(black, black, black))) == pytest.approx(21.0)
    assert val(one, color.rgb_distance([white] * 3, [black] * 3)) == pytest.approx(1.0)
    assert tuple(val(one, color.hsl_to_rgb(F.lit(120.0), F.lit(1.0), F.lit(0.5)))) == (0, 255, 0)
    assert tuple(val(one, color.ramp(F.lit(0.25), [(0.0, (0, 0, 0)), (0.5, (100, 50, 0))]))) == (50, 25, 0)
    assert tuple(val(one, color.ramp(F.lit(9.0), [(0.0, (0, 0, 0)), (0.5, (100, 50, 0))]))) == (100, 50, 0)


def test_policy_round_trip():
    assert Policy.from_dict({}) == Policy()
    p = Policy.from_dict({"aggregation": {"bloat_aggregation": {"kind": "power_mean_loss", "p": 3}}, "calibration": {"overrides": {"bloat_function": {"kind": "linear_decay_score", "zero_at": 4}}}, "normalization": {"overrides": {"bloat_function": {"kind": "cohort_mean", "min_count": 2}}}})
    assert p.bloat_aggregation.p == 3 and p.calibrator("bloat_function") == Calibrator("linear_decay_score", zero_at=4)
    assert Policy.from_dict(p.to_dict()) == p
    with pytest.raises(ValueError):
        Policy.from_dict({"nonsense": {}})
