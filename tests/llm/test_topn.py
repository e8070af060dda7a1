import math
import random

from tallyforge.llm.topn import _again, top_per_group

SCHEMA = "g string, h string, s double, line long, name string, id long, g0 string, o int"


def brute(rows, n):
    seen, out = set(), {}
    for g, h, s, line, name, i, *_ in rows:
        if None in (g, h, s) or i is None or math.isnan(s) or i in seen:
            continue
        seen.add(i)
        out.setdefault((g, h), []).append((-s, (line is not None, line or 0), (name is not None, (name or "").encode()), i))
    return {k: [x[3] for x in sorted(v)[:n]] for k, v in out.items()}


def run(spark, rows, n=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in top_per_group(df, ["g", "h"], "s", ["line", "name"], "id", n, **kw).collect():
        got.setdefault((r["g"], r["h"]), []).append((r["position"], r["id"]))
    return {k: [i for _, i in sorted(v)] for k, v in got.items()}


def test_random_ties_nulls_and_copies(spark):
    rnd = random.Random(1)
    rows = [
        (rnd.choice(["a", "a", "a", "b", None]), rnd.choice(["x", "y"]), rnd.choice([0.5, 0.5, 0.25, 1.0, 0.0, -0.0, None, float("nan"), float("inf")]), rnd.choice([None, 1, 2]), rnd.choice(["é", "z", "Z", None]), i, "q", 1)
        for i in range(400)
    ]
    rows += rnd.sample(rows, 60)
    assert run(spark, rows) == brute(rows, 3)


def test_copies_that_fill_the_heap_lose_nothing(spark):
    rows = [("a", "x", 9.0, 1, "n", 1, "q", 1)] * 50 + [("a", "x", float(s), 1, "n", s, "q", 1) for s in range(2, 8)]
    assert run(spark, rows) == {("a", "x"): [1, 7, 6]}
    assert run(spark, rows, slots=3) == {("a", "x"): [1, 7, 6]}


def test_small_and_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "x", 1.0, None, None, 5, None, None)]) == {("a", "x"): [5]}


def test_scores_keep_their_type(spark):
    big = 2**53
    df = spark.createDataFrame([("a", "x", big + i, 1, "n", i) for i in range(4)] + [("a", "y", -(2**63), 1, "n", 9)], "g string, h string, s long, line long, name string, id long")
    rows = {(r["h"], r["position"]): (r["id"], r["s"]) for r in top_per_group(df, ["g", "h"], "s", ["line", "name"], "id", 2).collect()}
    assert rows == {("x", 1): (3, big + 3), ("x", 2): (2, big + 2), ("y", 1): (9, -(2**63))}


def test_the_second_look_limits_before_its_shuffle(spark, capsys):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, o long").repartition(3)
    plan = _again(df, ["k"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
