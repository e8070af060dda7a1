"""Connected components of billions of links, by stripping, chain compression and a reduced core."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")


def _neighbours(edges: DataFrame) -> DataFrame:
    """Degree and two of the neighbours (all of them for degrees one and two) of every vertex."""
    return _both_ways(edges).groupBy("x").agg(F.count("*").alias("d"), F.min("y").alias("a"), F.max("y").alias("b"))


def _strip_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed vertex, parent) of all degree-one vertices, and the edges that go with them.

    Of an edge that stands alone the larger end is removed and the smaller one stays as its root.
    """
    leaf = _neighbours(edges).filter("d = 1")
    cut = leaf.groupBy(F.least("x", "a").alias("u"), F.greatest("x", "a").alias("v")).agg(F.max("x").alias("node"))
    return cut.select("node", F.when(F.col("node") == F.col("v"), F.col("u")).otherwise(F.col("v")).alias("parent")), cut.select("u", "v")


def _rank_chains(edges: DataFrame, seed: int, scratch: Scratch) -> DataFrame | None:
    """(node, p, q): the inner vertices of chains, and the two ends of the sublist each lies in; None if there are none.

    Degree-two vertices whose hash is less than both neighbours' are rulers and stay; each cycle has one, so no sublist closes
    on itself, and the sublists between rulers are short. They are ranked by pointer jumping over directed arcs.
    """
    h = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    inner = scratch.save(_neighbours(edges).filter(F.col("d") == 2).filter((h("x") >= h("a")) | (h("x") >= h("b"))).select("x", "a", "b"))
    if inner.isEmpty():
        return None
    arcs = inner.select(F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("x").alias("n"), F.col("x").alias("pf"), F.col("b").alias("pn")), F.struct(F.col("b").alias("f"), F.col("x").alias("n"), F.col("x").alias("pf"), F.col("a").alias("pn")))).alias("e")).select("e.*")
    arcs = arcs.withColumn("open", F.lit(True))
    while True:
        ahead = arcs.select(F.col("f").alias("pf"), F.col("n").alias("pn"), F.col("pf").alias("qf"), F.col("pn").alias("qn"), F.col("open").alias("more"))
        jumped = arcs.filter("open").join(ahead, ["pf", "pn"], "left").select("f", "n", F.coalesce("qf", "pf").alias("pf"), F.coalesce("qn", "pn").alias("pn"), F.coalesce("more", F.lit(False)).alias("open"))
        nxt = scratch.save(arcs.filter("not open").unionByName(jumped))
        scratch.free(arcs)
        arcs = nxt
        if arcs.filter("open").isEmpty():
            break
    return arcs.groupBy(F.col("n").alias("node")).agg(F.min("pn").alias("p"), F.max("pn").alias("q"))


def _solve_core(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of a graph, by alternating large-star and small-star contraction until the edges are stars."""
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while True:
        least = _neighbours(edges).select("x", F.least("x", "a").alias("m"))
        large = _both_ways(edges).filter("y > x").join(least, "x").select(F.least("y", "m").alias("u"), F.greatest("y", "m").alias("v"))
        large = scratch.save(large.filter("u < v").distinct())
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.least("u", "m").alias("u"), F.greatest("u", "m").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.*")
        nxt = scratch.save(small.filter("u < v").distinct())
        scratch.free(large, edges)
        edges = nxt
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def connected_components(links: DataFrame, a: str, b: str, least_gain: float = 0.25, salts: int = 16) -> DataFrame:
    """(node, component): one row for each vertex linked to another; ``component`` is the smallest vertex it reaches.

    Rounds of stripping degree-one vertices and compressing degree-two chains (list ranking between rulers) shrink the
    graph until a round removes less than ``least_gain`` of the edges; the core that is left is contracted to stars; the removed
    vertices then get their labels back along the pointers to what they were removed for. Every step is a join or a mergeable aggregate over tables in
    the shared folder; links, vertices and labels never come to the driver, and a vertex of any degree is only ever aggregated.

    Links with a null end and links of a vertex to itself are ignored; repeated and reversed links count once; an empty table
    gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(links.sparkSession)
    u, v = F.col(a), F.col(b)
    edges = links.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()
    edges = scratch.save(edges)
    removed: list[DataFrame] = []
    rounds, size = 0, edges.count()
    while size:
        rounds += 1
        pairs, gone = _strip_leaves(edges)
        removed.append(scratch.save(pairs))
        rest = scratch.save(edges.join(gone, ["u", "v"], "left_anti"))
        scratch.free(edges)
        edges = rest
        ranked = _rank_chains(edges, rounds, scratch)
        if ranked is not None:
            ranked = scratch.save(ranked)
            removed.append(ranked.select("node", F.col("p").alias("parent")))
            kept = edges
            for c in ("u", "v"):
                kept = kept.join(ranked.select(F.col("node").alias(c)), c, "left_anti")
            bridge = ranked.filter("p < q").select(F.col("p").alias("u"), F.col("q").alias("v"))
            rest = scratch.save(kept.select("u", "v").unionByName(bridge).distinct())
            scratch.free(edges)
            edges = rest
        now = edges.count()
        if size - now <= least_gain * size:
            break
        size = now
    kind = edges.schema["u"].dataType.simpleString()
    if edges.isEmpty():
        labels = links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    else:
        labels = _solve_core(edges, scratch)
    if removed:
        # each removed vertex points to one that was removed later or stayed: pointers are doubled until all of them
        # leave the removed vertices, in as many steps as the number of removals has binary digits
        up = removed[0]
        for level in removed[1:]:
            up = up.unionByName(level)
        for _ in range(len(removed).bit_length()):
            ahead = up.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            up = scratch.save(up.join(ahead, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent")))
        # a parent without a label is itself a root
        found = up.join(labels.select(F.col("node").alias("parent"), "root"), "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
        labels = scratch.save(labels.unionByName(found))
    # a root may be larger than a vertex below it: the least of all is taken per root; a root of a third of all vertices
    # is one row here, repeated once per salt, so its vertices spread over the salts
    least = labels.groupBy("root").agg(F.min("node").alias("m")).select("root", F.least("m", "root").alias("component"))
    salted = least.select("root", "component", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    below = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(salted, ["root", "salt"]).select("node", "component")
    return below.unionByName(least.select(F.col("root").alias("node"), "component"))


def links_of_groups(groups: DataFrame, members) -> DataFrame:
    """(a, b): links that join the members of each group in a star around its least member, never all pairs.

    ``members`` is an array column of ids; nulls and repeated members count for nothing.
    """
    m = F.array_distinct(F.filter(members, lambda x: x.isNotNull()))
    return groups.select(m.alias("m")).filter(F.size("m") > 1).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b")
