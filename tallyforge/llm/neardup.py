"""Pairs of sets of runs above a similarity threshold: an exact join that skips by set relations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch

#: Size of the table of run frequencies; runs that share a cell share a frequency. It is what is sent to the driver and
#: broadcast, whatever the data (two MB).
FREQUENCY_CELLS = 1 << 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
WORDS = 4  # of 64 bits, in a set's parity bitmap


class NearDuplicates(NamedTuple):
    members: DataFrame  # (id, class): every record of enough tokens; equal sequences share a class
    pairs: DataFrame  # (a, b, similarity), a < b: classes above the threshold


def _mix(x: np.ndarray, m: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * m
    return x ^ (x >> np.uint64(29))


def distinct_runs(tokens: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, run hash) of the distinct runs of ``k`` tokens of each sequence, ordered by both."""
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.concatenate(tokens).astype(np.int64).view(np.uint64) if len(tokens) else np.empty(0, np.uint64)
    if len(flat) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = np.zeros(len(flat) - k + 1, dtype=np.uint64)
    for i in range(k):
        runs = _mix(runs + flat[i : len(flat) - k + 1 + i], _M1) + np.uint64(i + 1)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    inside = owner[: len(runs)] == owner[k - 1 :]
    owner, runs = owner[: len(runs)][inside], runs[inside]
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (runs[1:] != runs[:-1])
    return owner[new], runs[new]


def _cell(runs: np.ndarray) -> np.ndarray:
    return (_mix(runs, _M2) % np.uint64(FREQUENCY_CELLS)).astype(np.int64)


def _frequencies(k: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(FREQUENCY_CELLS, dtype=np.int64)
        for b in batches:
            total += np.bincount(_cell(distinct_runs(b["tokens"].tolist(), k)[1]), minlength=FREQUENCY_CELLS)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "c": total[cells]})

    return count


def _sets(k: int, frequency):
    """Each set's runs in the global order (rarest first), a sketch, and a parity bitmap: the bit of a run is flipped by it."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare = frequency.value
        for b in batches:
            owner, runs = distinct_runs(b["tokens"].tolist(), k)
            order = np.lexsort((runs, rare[_cell(runs)], owner))
            owner, runs = owner[order], runs[order]
            n = np.bincount(owner, minlength=len(b))
            starts = np.concatenate(([0], np.cumsum(n)))
            bits = np.zeros((len(b), WORDS), dtype=np.uint64)
            at = _mix(runs, _M3) % np.uint64(64 * WORDS)
            np.bitwise_xor.at(bits, (owner, (at // np.uint64(64)).astype(np.int64)), np.uint64(1) << (at % np.uint64(64)))
            least = np.full(len(b), np.iinfo(np.uint64).max, dtype=np.uint64)
            np.minimum.at(least, owner, _mix(runs, _M2))
            signed = runs.view(np.int64)
            yield pd.DataFrame({"cls": b["cls"], "n": n.astype(np.int32), "sketch": least.view(np.int64), **{f"w{i}": bits[:, i].copy().view(np.int64) for i in range(WORDS)}, "runs": [signed[starts[i] : starts[i + 1]] for i in range(len(b))]})

    return build


def _shared(a, b) -> Column:
    return F.size(F.array_intersect(a, b))


def near_duplicates(df: DataFrame, row_id: str, sequence: str, threshold: float = 0.8, run: int = 3, least_tokens: int = 20, radius: float = 0.05, every_pair: bool = True) -> NearDuplicates:
    """Records whose token sequences have a Jaccard similarity of distinct runs strictly above ``threshold``.

    Equal sequences form one class, and the join works on classes. Set relations are used twice. Index level: the runs of
    a set stand in one global order, rarest first; only a prefix is listed, and the list of a run is cut into blocks by
    position from the set's end; a probe reads the two blocks in which a partner's position can lie and skips all others. Answer
    level: sets within distance ``radius`` of another one that shares their sketch are its followers; they are not listed at all.
    Their answers are derived from the leader's, found with a threshold widened by the followers' true distances
    (triangle inequality), by counting only over the few runs in which they differ. Both are exact: no pair is lost or capped.
    Parity bitmaps reject nearly all other candidates inside the join, before any set is fetched.

    Without ``every_pair`` the pairs are those that groups need: followers with their leader, but not with each other, and pairs of
    followers of two leaders only where the leaders themselves are no pair. The groups are the same; a crowd of alike records then
    costs one row for each, not one for each two.

    Tokens are compared by 64-bit hashes. Null sequences and those shorter than ``least_tokens`` belong to no class; a null token is a
    token of its own; a repeated id counts once; null ids are left out; an empty table gives empty results; other columns are ignored.
    """
    every_pair = every_pair or radius >= 1 - threshold  # a follower might then be no partner of its leader
    spark = df.sparkSession
    scratch = Scratch(spark)
    token = F.transform(F.col("s"), lambda t: F.xxhash64(F.coalesce(t.cast("string"), F.lit("\0"))))
    rows = df.filter(F.col(row_id).isNotNull() & (F.size(sequence) >= max(least_tokens, run))).select(F.col(row_id).alias("id"), F.col(sequence).alias("s")).dropDuplicates(["id"])
    rows = rows.select("id", token.alias("tokens")).select("*", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(7), "tokens", F.size("tokens")).alias("h2"))
    rows = scratch.save(rows)
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("cls"))
    members = scratch.save(rows.select("id", "h1", "h2").join(first, ["h1", "h2"]).select("id", F.col("cls").alias("class")))
    unique = scratch.save(rows.join(first.select(F.col("cls").alias("id")), "id", "left_semi").select(F.col("id").alias("cls"), "tokens"))
    scratch.free(rows)

    cells = unique.mapInPandas(_frequencies(run), "cell bigint, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    frequency = np.zeros(FREQUENCY_CELLS, dtype=np.int64)
    frequency[cells["cell"].to_numpy(dtype=np.int64)] = cells["c"].to_numpy(dtype=np.int64)
    kind = unique.schema["cls"].dataType.simpleString()
    words = [f"w{i}" for i in range(WORDS)]
    schema = f"cls {kind}, n int, sketch bigint, {', '.join(f'{w} bigint' for w in words)}, runs array<bigint>"
    sets = scratch.save(unique.mapInPandas(_sets(run, spark.sparkContext.broadcast(frequency)), schema))
    scratch.free(unique)

    # followers: one comparison per set, with the least of those that share its sketch
    heads = sets.groupBy("sketch").agg(F.min("cls").alias("leader"), F.count("*").alias("c")).filter("c > 1").drop("c")
    near = sets.join(heads, "sketch").filter("cls <> leader").select("cls", "n", "runs", "leader")
    near = near.join(sets.select(F.col("cls").alias("leader"), F.col("runs").alias("lruns"), F.col("n").alias("ln")), "leader")
    near = near.withColumn("o", _shared("runs", "lruns")).withColumn("dist", 1 - F.col("o") / (F.col("n") + F.col("ln") - F.col("o")))
    followers = near.filter(F.col("dist") <= radius).select("cls", "leader", "n", "ln", "o", "dist", F.array_except("runs", "lruns").alias("plus"), F.array_except("lruns", "runs").alias("minus"))
    followers = scratch.save(followers)
    reach = followers.groupBy(F.col("leader").alias("cls")).agg(F.max("dist").alias("rho"))
    widest = float(reach.agg(F.max("rho")).first()[0] or 0.0)
    leaders = sets.join(followers.select("cls"), "cls", "left_anti").join(reach, "cls", "left").withColumn("rho", F.coalesce("rho", F.lit(0.0)))
    leaders = scratch.save(leaders)

    eps = 1e-9
    own = F.greatest(F.lit(threshold) - F.col("rho") - widest, F.lit(0.0))
    lowest = max(threshold - 2 * widest, eps)
    step = math.log(1 / lowest) if lowest < 1 else 1.0
    block = lambda x: F.floor(F.log(x) / step)
    prefix = lambda t: (F.col("n") - F.ceil(t * F.col("n") - eps) + 1).cast("int")

    def listed(size: Column) -> DataFrame:
        head = F.slice("runs", 1, F.least(F.col("n"), F.greatest(size, F.lit(1))))
        return leaders.select("cls", "n", "rho", *words, F.posexplode(head).alias("pos", "gram")).withColumn("r", F.col("n") - F.col("pos"))

    index = listed(prefix(2 * own / (1 + own))).withColumn("blk", block(F.col("r")))
    probe = listed(prefix(own)).withColumn("blk", F.explode(F.sequence(block(F.col("n") * lowest * (1 - eps)), block(F.col("n") * (1 + eps)))))
    x, y = probe.alias("x"), index.alias("y")
    t = F.lit(threshold) - F.col("x.rho") - F.col("y.rho")
    need = t / (1 + t) * (F.col("x.n") + F.col("y.n"))
    differ = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
    hit = (
        (F.col("x.gram") == F.col("y.gram"))
        & (F.col("x.blk") == F.col("y.blk"))
        & ((F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cls") < F.col("y.cls"))))
        & (F.least("x.r", "y.r") >= need - eps)
        & (differ <= F.col("x.n") + F.col("y.n") - 2 * need + eps)
    )
    candidates = x.join(y, hit).select(F.col("x.cls").alias("l"), F.col("y.cls").alias("m")).distinct()
    side = lambda c, p: leaders.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("rho").alias(f"rho{c}"), F.col("runs").alias(p))
    found = candidates.join(side("l", "gl"), "l").join(side("m", "gm"), "m").withColumn("o", _shared("gl", "gm"))
    found = found.withColumn("sim", F.col("o") / (F.col("nl") + F.col("nm") - F.col("o")))
    found = scratch.save(found.filter(F.col("sim") > F.lit(threshold) - F.col("rhol") - F.col("rhom") - eps).select("*"))

    direct = found.select(F.col("l").alias("a"), F.col("m").alias("b"), "sim")
    direct = direct.unionByName(followers.select(F.col("leader").alias("a"), F.col("cls").alias("b"), (1 - F.col("dist")).alias("sim")))
    # followers and their leaders: the leader's own row has no differences
    diff = followers.select("leader", "cls", "dist", "n", "plus", "minus")
    led = reach.select(F.col("cls").alias("leader"))
    empty = F.array().cast("array<bigint>")
    itself = found.select(F.col("l").alias("cls"), F.col("nl").alias("n")).union(found.select("m", "nm")).distinct()
    family = diff.unionByName(itself.select(F.col("cls").alias("leader"), "cls", F.lit(0.0).alias("dist"), "n", empty.alias("plus"), empty.alias("minus")))
    f = lambda c, p: family.select(F.col("leader").alias(c), *[F.col(k).alias(p + k) for k in ("cls", "dist", "n", "plus", "minus")])
    wide = found.filter("rhol > 0 or rhom > 0").join(f("l", "x"), "l").join(f("m", "y"), "m").filter("xdist > 0 or ydist > 0 or xcls <> l or ycls <> m")
    wide = wide.filter((1 - F.col("sim")) - F.col("xdist") - F.col("ydist") < 1 - threshold + eps)
    if not every_pair:
        wide = wide.filter(F.col("sim") <= threshold)
    in_x = lambda c: _shared(c, F.col("gl")) - _shared(c, F.col("xminus")) + _shared(c, F.col("xplus"))
    o = F.col("o") + _shared("xplus", "gm") - _shared("xminus", "gm") + in_x(F.col("yplus")) - in_x(F.col("yminus"))
    derived = wide.select(F.col("xcls").alias("a"), F.col("ycls").alias("b"), o.alias("o"), (F.col("xn") + F.col("yn")).alias("s"))
    if every_pair:
        p, q = diff.alias("p"), diff.alias("q")
        siblings = p.join(q, (F.col("p.leader") == F.col("q.leader")) & (F.col("p.cls") < F.col("q.cls")))
        siblings = siblings.join(followers.groupBy("leader").agg(F.first("ln").alias("ln")).withColumnRenamed("leader", "head"), F.col("p.leader") == F.col("head"))
        o = F.col("ln") - F.size("p.minus") - F.size("q.minus") + _shared("p.minus", "q.minus") + _shared("p.plus", "q.plus")
        derived = derived.unionByName(siblings.select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b"), o.alias("o"), (F.col("p.n") + F.col("q.n")).alias("s")))
    pairs = direct.unionByName(derived.select("a", "b", (F.col("o") / (F.col("s") - F.col("o"))).alias("sim"))).filter(F.col("sim") > threshold)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("sim").alias("similarity"))
    return NearDuplicates(members, pairs)


def expand(found: NearDuplicates) -> DataFrame:
    """(a, b), a < b: the pairs of classes written out for their members, equal sequences included. As large as the result is."""
    m = found.members
    one, two = m.select(F.col("id").alias("a"), F.col("class").alias("ca")), m.select(F.col("id").alias("b"), F.col("class").alias("cb"))
    across = found.pairs.select(F.col("a").alias("ca"), F.col("b").alias("cb")).join(one, "ca").join(two, "cb").select("a", "b")
    equal = one.join(two, F.col("ca") == F.col("cb")).filter("a < b").select("a", "b")
    return equal.unionByName(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
