import random

import numpy as np
import pytest

from tallyforge.llm.ranking import numbered, rank_walk
from tallyforge.session import Scratch

NAMES = ["p", "q", "r"]


def brute(rows, damping=0.5):
    vals = {}
    for i, k, v in rows:
        if i is not None and k in NAMES and v is not None and v == v:
            vals.setdefault(i, {})[k] = v
    items = sorted(i for i, d in vals.items() if len(d) == len(NAMES))
    n = len(items)
    P = np.zeros((n, n))
    for k in NAMES:
        x = np.array([vals[i][k] for i in items])
        higher = x[None, :] > x[:, None]
        P += higher / n
        P[np.arange(n), np.arange(n)] += 1 - higher.sum(axis=1) / n
    P /= len(NAMES)
    w = np.ones(n) / n
    for _ in range(500):
        w = (1 - damping) / n + damping * w @ P
    return dict(zip(items, w))


def test_walk_against_matrix(spark):
    rnd = random.Random(1)
    rows = [(i, k, rnd.choice([rnd.gauss(0, 1), 0.0, 1e9 * rnd.random(), float("inf")])) for i in range(40) for k in NAMES]
    rows += [(100, "p", 1.0), (101, "p", None), (102, "q", float("nan")), (None, "p", 1.0), (3, "other", 5.0)] + rows[:7]
    df = spark.createDataFrame(rows, "item long, score string, v double")
    out = rank_walk(df, "item", "score", "v", NAMES, tolerance=1e-10).collect()
    want = brute(rows)
    assert {r["item"] for r in out} == set(want)
    for r in out:
        assert r["weight"] == pytest.approx(want[r["item"]], abs=1e-8)
    assert sorted(r["position"] for r in out) == list(range(1, len(out) + 1))
    placed = sorted(out, key=lambda r: r["position"])
    assert all(a["weight"] >= b["weight"] - 1e-12 for a, b in zip(placed, placed[1:]))


def test_scale_of_a_score_does_not_matter(spark):
    rnd = random.Random(2)
    rows = [(i, k, rnd.gauss(0, 1)) for i in range(20) for k in NAMES]
    order = lambda rs: [r["item"] for r in sorted(rank_walk(spark.createDataFrame(rs, "item long, score string, v double"), "item", "score", "v", NAMES).collect(), key=lambda r: r["position"])]
    assert order(rows) == order([(i, k, v * 1e6 if k == "p" else v) for i, k, v in rows])


def test_empty_and_incomplete(spark):
    df = spark.createDataFrame([(1, "p", 1.0)], "item long, score string, v double")
    assert rank_walk(df, "item", "score", "v", NAMES).collect() == []


def test_numbering(spark):
    df = spark.range(100).selectExpr("id", "(id * 37) % 100 as k").repartition(5)
    got = {r["k"]: r["n"] for r in numbered(df, ["k"], "n", Scratch(spark)).collect()}
    assert got == {k: k + 1 for k in range(100)}
