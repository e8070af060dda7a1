import random

from tallyforge.llm.components import connected_components, links_of_groups


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    groups = {}
    for x in up:
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    rows = connected_components(df, "a", "b").collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1] for r in rows}


CASES = {
    "path": [(i, i + 1) for i in range(60)],
    "cycles": [(i, i % 11 + 1) for i in range(1, 12)] + [(20, 21), (21, 22), (22, 20), (40, 41), (41, 40)],
    "star_with_tails": [(1000, i) for i in range(30)] + [(i, i + 100) for i in range(30)],
    "dirt": [(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (4, 5), (9, 8)],
    "lollipop": [(a, b) for a in range(6) for b in range(a)] + [(5, 50), (50, 51), (51, 52), (52, 5)],
}


def shifted(pairs, by):
    return [tuple(x if x is None else x + by for x in p) for p in pairs]


def test_shapes_together(spark):
    """Paths, cycles, stars, dirt, dense and sparse random graphs, as parts of one graph."""
    rnd = random.Random(3)
    cases = [*CASES.values(), [(rnd.randrange(120), rnd.randrange(120)) for _ in range(110)], [(rnd.randrange(20), rnd.randrange(20)) for _ in range(80)]]
    pairs = [p for k, c in enumerate(cases) for p in shifted(c, k * 10_000)]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, [(1, 1), (None, None)]) == {}


def test_groups_are_stars(spark):
    df = spark.createDataFrame([([5, 3, 9, 3, None],), ([7],), ([],), (None,), ([2, 2],)], "m array<long>")
    assert sorted(map(tuple, links_of_groups(df, df["m"]).collect())) == [(3, 5), (3, 9)]


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 7, 8, "x")], "a long, b long, u long, node long, root string")
    assert sorted(map(tuple, connected_components(df, "a", "b").collect())) == [(1, 1), (2, 1)]
