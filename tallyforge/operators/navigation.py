"""Finding one's way in trees kept as flat rows (``rollup``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import rollup


def find(tree: DataFrame, target: str) -> DataFrame:
    """The node named by ``rollup.key``, no row if there is none."""
    return tree.filter(rollup.key(F.col("path")) == target)


def cache(tree: DataFrame) -> DataFrame:
    """(key, parent, has_children) of every node; roots have no parent. One join by parent, no walk."""
    parents = tree.filter(F.size("parent") > 0).select(F.col("parent").alias("path")).distinct().withColumn("_has", F.lit(True))
    out = tree.join(parents, "path", "left")
    up = F.when(F.size("parent") > 0, rollup.key(F.col("parent")))
    return out.select(rollup.key(F.col("path")).alias("key"), up.alias("parent"), F.coalesce("_has", F.lit(False)).alias("has_children"))


def trail(tree: DataFrame) -> DataFrame:
    """(key, trail): for each node the relation of each node on its way, outermost first: 'last' if it is the last of its
    siblings, else 'inner'. As long as the path is deep."""
    ordered = rollup.pre_order(tree).select("path", "last")
    up = ordered.select("path", F.posexplode(rollup.prefixes(F.col("path"))).alias("i", "ancestor"))
    own = up.join(ordered.select(F.col("path").alias("ancestor"), "last"), "ancestor")
    own = own.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("last"), "last").otherwise("inner").alias("r")))).alias("t"))
    return own.select(rollup.key(F.col("path")).alias("key"), F.transform("t", lambda x: x["r"]).alias("trail"))


def relation_trail(tree: DataFrame, target: str) -> DataFrame:
    """(key, trail): for each node below a root the relations of its ancestors to ``target`` (``rollup.path_relations``), outermost
    first; 'unrelated' for those that have none."""
    known = rollup.path_relations(tree, target).select(F.col("path").alias("ancestor"), "relation")
    up = tree.filter(F.size("parent") > 0).select("path", F.posexplode(rollup.prefixes(F.col("parent"))).alias("i", "ancestor"))
    own = up.join(known, "ancestor", "left").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("relation", F.lit("unrelated")).alias("r")))).alias("t"))
    return own.select(rollup.key(F.col("path")).alias("key"), F.transform("t", lambda x: x["r"]).alias("trail"))


def violations(tree: DataFrame) -> DataFrame:
    """(nodes, orphans, repeated, bad_depth, bad_amount): how many rows break what holds for every tree: a parent for each node but the
    roots, one row per path, depths that fit, and no parent with less than its children together."""
    path = tree.select("path").distinct()
    orphans = tree.filter(F.size("parent") > 0).select(F.col("parent").alias("path")).join(path, "path", "left_anti").agg(F.count("*").alias("orphans"))
    sums = tree.filter(F.size("parent") > 0).groupBy(F.col("parent").alias("path")).agg(F.sum("responsibility").alias("below"))
    short = tree.join(sums, "path").filter(F.col("below") > F.col("responsibility") + 1e-6).agg(F.count("*").alias("bad_amount"))
    own = tree.agg(F.count("*").alias("nodes"), F.count_if(F.size("path") != F.col("depth")).alias("bad_depth"))
    out = own.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(short)).crossJoin(F.broadcast(path.agg(F.count("*").alias("_paths"))))
    return out.select("nodes", "orphans", (F.col("nodes") - F.col("_paths")).alias("repeated"), "bad_depth", "bad_amount")


def hints(bindings: DataFrame) -> DataFrame:
    """(key, label) of the bindings that have a label and whose guard holds; no guard always holds."""
    return bindings.filter(F.col("label").isNotNull() & (F.col("label") != "") & F.coalesce(F.col("guard"), F.lit(True))).select("key", "label")
