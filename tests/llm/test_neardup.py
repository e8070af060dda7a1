import random

from tallyforge.llm.neardup import expand, near_duplicates

KINDS = ["Let", "If", "Call", "Loop", "Match", "Try", "Block"]
SCHEMA = "id long, s array<string>, cls string, runs int"


def grams(s, k=3):
    s = [x if x is not None else "\0" for x in s]
    return {tuple(s[i : i + k]) for i in range(len(s) - k + 1)}


def brute(rows, t=0.8, least=20):
    sets = {i: grams(s) for i, s, *_ in rows if i is not None and s is not None and len(s) >= least}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > t}


def make(n, seed, edits):
    rnd = random.Random(seed)
    base = [[rnd.choice(KINDS) for _ in range(rnd.randrange(20, 90))] for _ in range(n)]
    out = []
    for s in base:
        for _ in range(rnd.randrange(1, 6)):
            c = list(s)
            for _ in range(rnd.randrange(edits + 1)):
                p = rnd.randrange(len(c))
                c[p : p + 1] = rnd.choice([[], [rnd.choice(KINDS)], [c[p], rnd.choice(KINDS)]])
            out.append(c)
    return [(i, c, "x", 1) for i, c in enumerate(out)]


def run(spark, rows, **kw):
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "s", **kw)
    got = [tuple(r) for r in expand(found).collect()]
    assert len(got) == len(set(got))
    return set(got), found


def test_families_of_edits(spark):
    rows = make(30, 1, 3)
    rows += rows[:10]
    got, found = run(spark, rows)
    assert got == brute(rows) and got
    assert all(abs(r.similarity) > 0.8 for r in found.pairs.collect())


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def test_fewer_pairs_give_the_same_groups(spark):
    base = [random.Random(8).choice(KINDS) for _ in range(120)]
    rows = make(20, 7, 4) + [(1000 + i, base[:i] + ["Try"] + base[i + 1 :], "x", 1) for i in range(30)]
    got, few = run(spark, rows, every_pair=False)
    want = brute(rows)
    assert components(got) == components(want) and got < want and few.pairs.count() < near_duplicates(spark.createDataFrame(rows, SCHEMA), "id", "s").pairs.count()


def test_wide_radius_and_low_threshold(spark):
    rows = make(15, 2, 5)
    got, _ = run(spark, rows, threshold=0.5, radius=0.2)
    assert got == brute(rows, 0.5)


def test_nulls_short_and_equal(spark):
    s = [KINDS[i % 5] for i in range(30)]
    rows = [(1, s, "x", 1), (2, s, "y", 2), (3, None, "x", 1), (4, [], "x", 1), (5, s[:10], "x", 1), (None, s, "x", 1), (6, [None, *s[1:]], "x", 1), (7, ["Let"] * 25, "x", 1), (8, ["Let"] * 40, "x", 1)]
    got, _ = run(spark, rows)
    assert got == brute(rows) and (1, 2) in got and (7, 8) in got


def test_empty(spark):
    assert run(spark, [])[0] == set()
