import random

import numpy as np

from tallyforge.llm.percentiles import exact_percentiles

SCHEMA = "g string, v double, id long, q0 string, n int"


def brute(rows, probs):
    vals, seen = {}, set()
    for g, v, i, *_ in rows:
        if v is None or i is None or not np.isfinite(v) or i in seen:
            continue
        seen.add(i)
        vals.setdefault(g, []).append(v)
    return {g: (len(v), *np.percentile(v, [100 * p for p in probs])) for g, v in vals.items()}


def check(spark, parts, probs=(0.0, 0.25, 0.5, 0.9, 1.0), **kw):
    dfs = [spark.createDataFrame(p, SCHEMA) for p in parts]
    got = {r["g"]: (r["n"], *[r[f"q{i}"] for i in range(len(probs))]) for r in exact_percentiles(dfs, ["g"], "v", "id", list(probs), **kw).collect()}
    want = brute([r for p in parts for r in p], probs)
    assert got.keys() == want.keys()
    for g in want:
        np.testing.assert_allclose(got[g], want[g], rtol=1e-12)


def rows(n, seed, first=0):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "a", "b", None]), rnd.choice([0.0, 0.0, 0.0, rnd.gauss(0, 5), 1e300, None, float("nan"), float("inf")]), first + i, "x", 1) for i in range(n)]


def test_random_with_copies(spark):
    r = rows(500, 1)
    check(spark, [r + r[:40]], partitions=5)


def test_days_combine(spark):
    a, b = rows(200, 2), rows(150, 3, 200)
    check(spark, [a, b + a[:20]], partitions=3)


def test_one_value_everywhere_and_single_rows(spark):
    check(spark, [[("a", 3.0, i, None, None) for i in range(50)] + [("b", 1.5, 99, None, None)]], partitions=7)


def test_empty(spark):
    check(spark, [[]])
