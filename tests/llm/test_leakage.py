import random
import re

from tallyforge.llm.leakage import build_index, leaked_items, matches, passages


def runs(t, n):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, n):
    q = {i: runs(t, n) for i, t in items if i is not None}
    return {(d, i) for d, t in docs if d is not None for i, r in q.items() if runs(t, n) & r}


def run(spark, docs, items, n=12, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "t").selectExpr("item_id", "t as text", "1 as doc_id")
    got = [tuple(r) for r in leaked_items(d, i, n=n, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def make(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 40)))) for i in range(40)]
    docs = []
    for d in range(60):
        words = [rnd.choice([*vocab, "zz", "Y-y"]) for _ in range(rnd.randrange(0, 120))]
        src = rnd.choice(items)[1].split()
        a = rnd.randrange(len(src))
        p = rnd.randrange(len(words) + 1)
        words[p:p] = [w.upper() if rnd.random() < 0.3 else w for w in src[a : a + rnd.randrange(1, 20)]]
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(words)))
    return docs, items


def test_random_and_shards(spark):
    docs, items = make(1)
    want = brute(docs, items, 6)
    assert want and run(spark, docs, items, 6) == want
    assert run(spark, docs, items, 6, shard_rows=7) == want
    assert run(spark, docs, items, 6, shard_chars=300, width=9) == want


def test_dirt(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    items = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (3, "a b"), (4, None), (None, "a b c d e f g h i j k l"), (5, " ".join(f"x{i}" for i in range(4000, 4020))), (1, "a b c d e f g h i j k l")]
    docs = [(1, "A.b,c d\ne f g h i j k L!"), (1, "A.b,c d\ne f g h i j k L!"), (2, None), (3, ""), (4, long), (None, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k")]
    assert run(spark, docs, items) == {(1, 1), (1, 2), (4, 5)}


def test_empty(spark):
    assert run(spark, [], [(1, "a b c")]) == set()
    assert run(spark, [(1, "a b c")], []) == set()


def test_block_bounds_skip_postings_and_lose_nothing():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(12, 40)))) for i in range(300)]
    index = build_index(items, 6, block=8)
    for i in range(len(index.words)):
        own = index.item[index.start[i] : index.start[i + 1]]
        assert (own[1:] > own[:-1]).all()
        for b, top in zip(index.block[index.block_start[i] : index.block_start[i + 1]], index.block_max[index.block_start[i] : index.block_start[i + 1]]):
            assert index.impact[index.start[i] : index.start[i + 1]][own // 8 == b].max() == top
    docs = []
    for d in range(200):
        src = rnd.choice(items)[1].split()
        a = rnd.randrange(len(src) - 8)
        docs.append((d, " ".join([rnd.choice(vocab) for _ in range(30)] + src[a : a + rnd.randrange(4, 9)])))
    queue = [(d, p) for d, t in docs for p in passages(t, index.words, 6, 20)]
    assert set(matches(queue, index)) == brute(docs, items, 6)
