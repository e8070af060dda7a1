"""Exact groups and near pairs of token sequences, and the share of items in either."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sets import run_hashes


def exact_groups(df: DataFrame, shape: str = "shape", member: str = "fn_id", least: int = 5) -> DataFrame:
    """(shape_length, members, first) of sequences of at least ``least`` tokens that occur more than once.

    Only (hash, length, member) is shuffled, never the sequences: two independent 64-bit hashes stand for one.
    """
    rows = df.filter(F.size(shape) >= least).select(F.xxhash64(shape).alias("h1"), F.hash(shape).alias("h2"), F.size(shape).cast("bigint").alias("shape_length"), F.col(member).alias("m"))
    return rows.groupBy("h1", "h2", "shape_length").agg(F.count("*").alias("members"), F.min("m").alias("first")).filter("members > 1").select("shape_length", "members", "first")


def exact_members(df: DataFrame, shape: str = "shape", member: str = "fn_id", least: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(by, member, first) for every item of an exact group; ``first`` names the group by its least member. Groups never
    reach across the values of ``by``."""
    rows = df.filter(F.size(shape) >= least).select(*by, F.xxhash64(shape).alias("h1"), F.hash(shape).alias("h2"), F.size(shape).alias("n"), F.col(member).alias("m"))
    groups = rows.groupBy(*by, "h1", "h2", "n").agg(F.count("*").alias("c"), F.min("m").alias("first")).filter("c > 1").drop("c")
    return rows.join(groups, [*by, "h1", "h2", "n"]).select(*by, F.col("m").alias(member), "first")


#: Cells of the table of run frequencies. It goes to the driver and into the plan, whatever the data; runs that share a cell share a frequency.
FREQUENCY_CELLS = 8192


def _rarest_first(sets: DataFrame, runs: str) -> Column:
    """The runs of a set in one global order, the rarest first: a prefix then lists runs that few sets have."""
    cell = lambda h: F.pmod(F.shiftright(h, 20), F.lit(FREQUENCY_CELLS)).cast("int")
    seen = sets.select(F.explode(runs).alias("h")).groupBy(cell(F.col("h")).alias("c")).agg(F.count("*").alias("n")).collect()
    counts = [0] * FREQUENCY_CELLS
    for r in seen:
        counts[r["c"]] = r["n"]
    table = F.from_json(F.lit(str(counts)), "array<bigint>")  # a constant: it is folded once
    return F.transform(F.array_sort(F.transform(runs, lambda h: F.struct(F.element_at(table, cell(h) + 1).alias("n"), h.alias("h")))), lambda x: x["h"])


def near_pairs(df: DataFrame, shape: str = "shape", member: str = "fn_id", threshold: float = 0.8, least: int = 5, length_ratio: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, similarity), a < b: items in no exact group whose distinct 3-grams have a Jaccard similarity above
    ``threshold``, both with the same ``by``.

    Prefix filter: the runs of a set are ordered by their frequency over all sets, and only the first n - ceil(t n) + 1 are joined on; any pair
    above the threshold meets in one of them, and hot runs stand in hardly any prefix. Size and length bounds and a parity bitmap (each run flips one of 128 bits, so
    differing bits bound the difference of the sets from below) are part of the join's condition; what passes is made
    distinct and verified on the full sets.
    """
    rows = df.filter(F.size(shape) >= least).select(*by, F.col(member).alias("m"), F.col(shape).alias("s"))
    single = rows.join(exact_members(df, shape, member, least, by).select(*by, F.col(member).alias("m")), [*by, "m"], "left_anti")
    sets = single.select(*by, "m", run_hashes(F.col("s"), 3).alias("g"), F.size("s").alias("len")).withColumn("n", F.size("g"))
    sets = sets.withColumn("g", _rarest_first(sets, "g"))
    flip = lambda half: F.aggregate("g", F.lit(0).cast("bigint"), lambda a, h: F.when(F.pmod(F.shiftright(h, 6), F.lit(2)) == half, a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int")))).otherwise(a))
    sets = sets.withColumn("w0", flip(0)).withColumn("w1", flip(1))
    head = sets.select(*by, "m", "n", "len", "w0", "w1", F.explode(F.slice("g", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("k"))
    x, y = head.alias("x"), head.alias("y")
    fits = (F.least("x.n", "y.n") > threshold * F.greatest("x.n", "y.n") - 1e-9) & (F.least("x.len", "y.len") >= length_ratio * F.greatest("x.len", "y.len"))
    differ = F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))) + F.bit_count(F.col("x.w1").bitwiseXOR(F.col("y.w1")))
    fits = fits & (differ <= (F.col("x.n") + F.col("y.n")) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    for c in by:
        fits = fits & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.m") < F.col("y.m")) & fits).select(*[F.col(f"x.{c}").alias(c) for c in by], F.col("x.m").alias("a"), F.col("y.m").alias("b")).distinct()
    side = lambda c: sets.select(*by, F.col("m").alias(c), F.col("g").alias(f"g{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).withColumn("o", F.size(F.array_intersect("ga", "gb")))
    return both.select(*by, "a", "b", (F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("similarity")).filter(F.col("similarity") > threshold)


def duplication_score(df: DataFrame, shape: str = "shape", member: str = "fn_id", least: int = 5, pairs: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, fingerprinted, exact, near, duplication_score): share of all items that stand in an exact group or a near pair.
    ``pairs`` is the output of ``near_pairs`` where it is there already."""
    pairs = near_pairs(df, shape, member, least=least, by=by) if pairs is None else pairs
    near = pairs.select(*by, F.explode(F.array("a", "b")).alias("m")).distinct().groupBy(*by).agg(F.count("*").alias("near"))
    exact = exact_members(df, shape, member, least, by).groupBy(*by).agg(F.count("*").alias("exact"))
    out = df.groupBy(*by).agg(F.count("*").alias("fingerprinted"))
    for own, c in ((exact, "exact"), (near, "near")):
        out = out.join(own, list(by), "left").withColumn(c, F.coalesce(c, F.lit(0).cast("bigint"))) if by else out.crossJoin(F.broadcast(own))
    return out.withColumn("duplication_score", F.when(F.col("fingerprinted") > 0, (F.col("exact") + F.col("near")) / F.col("fingerprinted")).otherwise(0.0))


def details(exact: DataFrame, near: DataFrame, member: str = "fn_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, member, detail): what each duplicated item is part of, exact groups first.

    ``exact`` has (by, member, first), ``near`` has (by, a, b, similarity). Equal texts of one item are merged before they are
    joined; an item's texts are as many as it has partners.
    """
    one = exact.select(*by, F.col(member), F.lit(0).alias("o"), F.concat(F.lit("same as "), F.col("first").cast("string")).alias("t"))
    pairs = near.select(*by, F.explode(F.array(F.struct(F.col("a").alias("m"), F.col("b").alias("p"), "similarity"), F.struct(F.col("b").alias("m"), F.col("a").alias("p"), "similarity"))).alias("x"))
    two = pairs.select(*by, F.col("x.m").alias(member), F.lit(1).alias("o"), F.concat(F.lit("near "), F.col("x.p").cast("string")).alias("t"))
    texts = F.array_sort(F.collect_set(F.struct("o", "t")))
    return one.unionByName(two).groupBy(*by, member).agg(F.array_join(F.transform(texts, lambda x: x["t"]), "; ").alias("detail"))
