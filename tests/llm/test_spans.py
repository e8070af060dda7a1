import random

from tallyforge.llm.spans import shared_spans

SCHEMA = "id long, s array<string>, a int, seg string"


def brute(rows, n):
    seqs = {i: [x if x is not None else "\0" for x in s] for i, s, *_ in rows if i is not None and s is not None}
    where = {}
    for i, s in seqs.items():
        for k in range(len(s) - n + 1):
            where.setdefault(tuple(s[k : k + n]), set()).add(i)
    out = set()
    for i, s in seqs.items():
        hit = [False] * len(s)
        for k in range(len(s) - n + 1):
            if len(where[tuple(s[k : k + n])]) > 1:
                hit[k : k + n] = [True] * n
        k = 0
        while k < len(s):
            if hit[k]:
                e = k
                while e < len(s) and hit[e]:
                    e += 1
                out.add((i, k, e))
                k = e
            else:
                k += 1
    return out


def run(spark, rows, n, **kw):
    got = [tuple(r) for r in shared_spans(spark.createDataFrame(rows, SCHEMA), "id", "s", n, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def make(seed, kinds="abc", count=40):
    rnd = random.Random(seed)
    pieces = [[rnd.choice(kinds) for _ in range(rnd.randrange(8, 30))] for _ in range(6)]
    out = []
    for i in range(count):
        s = []
        for _ in range(rnd.randrange(0, 4)):
            s += rnd.choice(pieces)[rnd.randrange(3) :] + [rnd.choice(kinds) for _ in range(rnd.randrange(6))]
        out.append((i, s, 1, "x"))
    return out


def test_random(spark):
    for seed in (1, 2):
        rows = make(seed)
        got = run(spark, rows + rows[:5], 12)
        assert got == brute(rows, 12) and got


def test_crowded_routes_are_split(spark):
    rows = make(3, "ab", 60)
    assert run(spark, rows, 9, crowd=3, shard_segments=5) == brute(rows, 9)


def test_copies_nulls_and_borders(spark):
    s = [f"t{i % 13}" for i in range(25)]
    rows = [(1, s, 1, "x"), (2, s, 1, "x"), (3, None, 1, "x"), (4, [], 1, "x"), (5, s[:10], 1, "x"), (6, ["q", *s[3:15], "r"], 1, "x"), (None, s, 1, "x"), (7, [None] * 12, 1, "x"), (8, [None] * 11 + ["z"], 1, "x")]
    assert run(spark, rows, 11) == brute(rows, 11)


def test_repeats_inside_one_record_do_not_count(spark):
    assert run(spark, [(1, ["a", "b"] * 20, 1, "x")], 6) == set()


def test_empty(spark):
    assert run(spark, [], 6) == set()
