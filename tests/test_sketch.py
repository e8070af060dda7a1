import numpy as np
import pytest

from tallyforge.operators.sketch import compress, merged, quantile, quantiles, sketches


def test_exact_up_to_the_limit():
    x = np.random.default_rng(1).normal(size=256)
    m, w = compress(x, np.ones(256))
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert quantile(m, w, x.min(), x.max(), p) == pytest.approx(np.quantile(x, p))


def test_compression_keeps_weight_and_mean():
    x = np.random.default_rng(2).exponential(size=5000)
    m, w = compress(x, np.ones(5000))
    assert len(m) == 128 and w.sum() == pytest.approx(5000) and (m * w).sum() == pytest.approx(x.sum())
    for p in (0.1, 0.25, 0.5, 0.75, 0.9):
        q = quantile(m, w, x.min(), x.max(), p)
        assert abs((x <= q).mean() - p) < 0.01


def test_merging_days_equals_one_pass_within_the_error(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), d) for g, n in (("a", 4000), ("b", 100), (None, 300)) for d, v in enumerate(rng.normal(size=n))]
    rows += [("a", float("nan"), 0), ("a", None, 1), ("a", float("inf"), 2)]
    df = spark.createDataFrame(rows, "g string, v double, d int").repartition(5)
    days = [sketches(df.filter(f"d % 3 = {k}"), ["g"], "v") for k in range(3)]
    got = {r["g"]: r for r in quantiles(merged(days[0].union(days[1]).union(days[2]), ["g"], 4), ["g"], [0.25, 0.5, 0.75]).collect()}
    for g, n in (("a", 4000), ("b", 100), (None, 300)):
        x = np.array([v for k, v, _ in rows if k == g and v is not None and np.isfinite(v)])
        assert got[g]["n"] == n
        for i, p in enumerate((0.25, 0.5, 0.75)):
            q = got[g][f"q{i}"]
            assert q == pytest.approx(np.quantile(x, p)) if n <= 256 else abs((x <= q).mean() - p) < 0.02
    assert quantiles(merged(sketches(df.limit(0), ["g"], "v"), ["g"]), ["g"], [0.5]).count() == 0
