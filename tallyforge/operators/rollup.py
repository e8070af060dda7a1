"""Rollups along scope paths, and trees kept as flat rows keyed by their path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def full_path(scope: Column, name: Column) -> Column:
    """The scope path; an empty one becomes a single function segment of the entry's own name."""
    own = F.array(F.struct(F.lit("function").alias("kind"), name.alias("name")))
    return F.when((F.size(scope) > 0), scope).otherwise(own)


def prefixes(path: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, 1, i))


def rollup_tree(entries: DataFrame, path: str = "scope_path", name: str = "function_name", amount: str = "responsibility", dimension: str = "dimension") -> DataFrame:
    """One row per node: path, depth, name, kind, responsibility, entries, dimensions (amount by dimension), parent.

    Entries are first summed per (path, dimension), so only distinct paths are exploded to their prefixes; a root
    holds all rows below it but only ever receives partial sums.
    """
    base = entries.select(full_path(F.col(path), F.col(name)).alias("p"), F.col(dimension).alias("d"), F.col(amount).alias("r"))
    base = base.groupBy("p", "d").agg(F.sum("r").alias("r"), F.count("*").alias("c"))
    nodes = base.select(F.explode(prefixes(F.col("p"))).alias("path"), "d", "r", "c").groupBy("path", "d").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    nodes = nodes.groupBy("path").agg(F.sum("r").alias("responsibility"), F.sum("c").alias("entries"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "r")))).alias("dimensions"))
    last = F.element_at("path", -1)
    return nodes.select("path", F.size("path").cast("bigint").alias("depth"), last["name"].alias("name"), last["kind"].alias("kind"), "responsibility", "entries", "dimensions", F.slice("path", 1, F.size("path") - 1).alias("parent"))


def key(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["kind"], F.lit(":"), s["name"])), "/")


def dimension_amounts(tree: DataFrame, names: list[str]) -> DataFrame:
    """The tree with one column per dimension, 0 where a node has none."""
    return tree.select("path", "depth", "name", "responsibility", *[F.coalesce(F.try_element_at("dimensions", F.lit(d)), F.lit(0.0)).alias(d) for d in names])


def hottest(entries: DataFrame, path: str = "scope_path", name: str = "function_name") -> DataFrame:
    """(path, file, line, dimension, function_name, responsibility) of the hottest entry at or below each node.

    Ties go to the smallest file, line, dimension, name. An argmax is a mergeable aggregate.
    """
    order = F.struct((-F.col("responsibility")).alias("r"), "file", "line", "dimension", name)
    base = entries.select(full_path(F.col(path), F.col(name)).alias("p"), order.alias("o")).groupBy("p").agg(F.min("o").alias("o"))
    best = base.select(F.explode(prefixes(F.col("p"))).alias("path"), "o").groupBy("path").agg(F.min("o").alias("o"))
    return best.select("path", F.col("o.file").alias("file"), F.col("o.line").alias("line"), F.col("o.dimension").alias("dimension"), F.col(f"o.{name}").alias(name), (-F.col("o.r")).alias("responsibility"))


def with_root(tree: DataFrame, name: str = "all") -> DataFrame:
    """The tree with a grand-total node above it if it has more than one root."""
    roots = tree.filter("depth = 1")
    total = roots.agg(F.sum("responsibility").alias("responsibility"), F.sum("entries").alias("entries"), F.count("*").alias("_n")).filter("_n > 1")
    root = total.select(F.slice(F.array(F.struct(F.lit("module").alias("kind"), F.lit(name).alias("name"))), 2, 1).alias("path"), F.lit(0).cast("bigint").alias("depth"), F.lit(name).alias("name"), "responsibility", "entries")
    return tree.select("path", "depth", "name", "responsibility", "entries").unionByName(root)


def pre_order(tree: DataFrame) -> DataFrame:
    """The tree with ``ids``, the ranks of each ancestor among its siblings (falling amount, name, kind): sorting by this array
    is depth-first pre-order, for a tree of any size. Windows run per parent."""
    w = Window.partitionBy("parent").orderBy(F.col("responsibility").desc(), "name", "kind")
    ranked = tree.withColumn("rank", F.row_number().over(w)).withColumn("last", F.row_number().over(w) == F.count("*").over(Window.partitionBy("parent")))
    up = ranked.select("path", F.posexplode(prefixes(F.col("path"))).alias("i", "ancestor"))
    ids = up.join(ranked.select(F.col("path").alias("ancestor"), "rank"), "ancestor").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))), lambda x: x["rank"]).alias("ids"))
    return ranked.join(ids, "path")


def visible(tree: DataFrame, expanded: list[str]) -> DataFrame:
    """Nodes whose ancestors are all expanded (named by ``key``)."""
    open_ = F.array(*[F.lit(x) for x in expanded]) if expanded else F.array().cast("array<string>")
    above = F.slice(prefixes(F.col("path")), 1, F.size("path") - 1)
    return tree.filter(F.forall(above, lambda a: F.array_contains(open_, key(a))))


def path_relations(tree: DataFrame, target: str) -> DataFrame:
    """(path, relation) to a target node: 'direct' for its ancestors, 'on_route' for earlier siblings of the nodes on its way."""
    ordered = pre_order(tree)
    goal = ordered.filter(key(F.col("path")) == target).select(F.col("path").alias("_p"), F.col("ids").alias("_ids"))
    both = ordered.crossJoin(F.broadcast(goal))  # the target is one node
    n = F.size("path")
    direct = (n < F.size("_p")) & (F.col("path") == F.slice("_p", 1, n))
    route = (n <= F.size("_p")) & (F.slice("path", 1, n - 1) == F.slice("_p", 1, n - 1)) & (F.col("rank") < F.get("_ids", n - 1))
    return both.withColumn("relation", F.when(direct, "direct").when(route, "on_route")).filter("relation is not null").select("path", "relation")


def apportion(df: DataFrame, group: list[str], amount: str, width: int, order: list[str]) -> DataFrame:
    """``df`` with ``cells``: whole cells in proportion to ``amount`` that add up to ``width`` per group (largest remainder, earlier
    rows first on ties)."""
    w = Window.partitionBy(*group)
    share = F.col(amount) * F.lit(float(width)) / F.sum(amount).over(w)
    out = df.withColumn("_q", F.when(F.sum(amount).over(w) > 0, share).otherwise(0.0)).withColumn("_f", F.floor("_q"))
    out = out.withColumn("_left", F.when(F.sum(amount).over(w) > 0, F.lit(width) - F.sum("_f").over(w)).otherwise(0))
    rank = F.row_number().over(w.orderBy((F.col("_q") - F.col("_f")).desc(), *order))
    return out.withColumn("cells", (F.col("_f") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("bigint")).drop("_q", "_f", "_left")


def legend(df: DataFrame, group: list[str], label: str, amount: str, width: int, order: list[str]) -> DataFrame:
    """Positive entries until their labels use up ``width``; the rest folded into one row with their number and share."""
    w = Window.partitionBy(*group)
    used = F.sum(F.length(label) + 2).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.filter(F.col(amount) > 0).withColumn("_fits", used <= width).withColumn("_all", F.sum(amount).over(w))
    shown = rows.filter("_fits").select(*group, F.col(label).alias("label"), F.lit(1).cast("bigint").alias("types"), (F.col(amount) / F.col("_all")).alias("share"))
    rest = rows.filter("not _fits").groupBy(*group).agg(F.count("*").alias("types"), (F.sum(amount) / F.max("_all")).alias("share")).select(*group, F.concat(F.lit("+"), F.col("types"), F.lit(" types")).alias("label"), "types", "share")
    return shown.unionByName(rest)


def ancestors(tree: DataFrame, target: str) -> DataFrame:
    """(depth, key): the nodes from the root to a target node."""
    at = tree.filter(key(F.col("path")) == target)
    return at.select(F.posexplode(prefixes(F.col("path"))).alias("i", "p")).select((F.col("i") + 1).cast("bigint").alias("depth"), key(F.col("p")).alias("key"))


def flame_rows(tree: DataFrame, target: str, width: int) -> DataFrame:
    """(key, depth, cells): the rows of a flame graph opened along the path to ``target``.

    Roots share ``width`` in proportion to their amounts, and so do the children of each node on the path, within its own
    cells; every row gets at least one cell. The loop runs once per level of the path, over the siblings of one node.
    """
    steps = [r["key"] for r in ancestors(tree, target).orderBy("depth").collect()]  # one row per level
    rows = tree.select(key(F.col("path")).alias("key"), key(F.col("parent")).alias("up"), "depth", "responsibility")
    top = rows.filter("depth = 1")
    total = top.agg(F.sum("responsibility").alias("all"))
    share = lambda w: F.greatest(F.floor(w * F.col("responsibility") / F.col("all")), F.lit(1)).cast("bigint")
    level = top.crossJoin(F.broadcast(total)).select("key", "depth", share(F.lit(width)).alias("cells"))
    out = level
    for step in steps:
        here = level.filter(F.col("key") == step).select(F.col("key").alias("up"), F.col("cells").alias("w"))
        below = rows.join(F.broadcast(here), "up")
        total = below.agg(F.sum("responsibility").alias("all"))
        level = below.crossJoin(F.broadcast(total)).select("key", "depth", share(F.col("w")).alias("cells"))
        out = out.unionByName(level)
    return out
