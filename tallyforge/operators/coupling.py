"""Coupling of modules from an edge list. ``by`` names the columns that tell snapshots apart (none for a single one)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def cross_edges(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct directed (caller_module, callee_module) pairs without self edges."""
    return edges.filter(F.col("caller_module") != F.col("callee_module")).select(*by, "caller_module", "callee_module").distinct()


def modules(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every module at either end of a cross edge."""
    e = cross_edges(edges, by)
    return e.select(*by, F.explode(F.array("caller_module", "callee_module")).alias("module")).distinct()


def density(edges: DataFrame) -> DataFrame:
    """(modules, edges, density): directed edges over all that there could be; 0 for one module or none."""
    e = cross_edges(edges)
    n = modules(edges).agg(F.count("*").alias("modules"))
    m = e.agg(F.count("*").alias("edges"))
    possible = F.col("modules") * (F.col("modules") - 1)
    return n.crossJoin(F.broadcast(m)).withColumn("density", F.when(F.col("modules") > 1, F.col("edges") / possible).otherwise(0.0))


def by_module(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, module, outgoing) for every module, 0 for those that are only called."""
    e = cross_edges(edges, by)
    out = e.groupBy(*by, F.col("caller_module").alias("module")).agg(F.count("*").alias("outgoing"))
    return modules(edges, by).join(out, [*by, "module"], "left").select(*by, "module", F.coalesce("outgoing", F.lit(0).cast("bigint")).alias("outgoing"))


def by_function(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, module, function, outgoing): distinct callee modules of each function, and a row without function for modules that
    no function row covers. Names are ``module::function``."""
    e = edges.filter((F.col("caller_module") != F.col("callee_module")))
    rows = e.filter(F.col("caller_function") != "").select(*by, "caller_module", "caller_function", "callee_module").distinct()
    own = rows.groupBy(*by, F.col("caller_module").alias("module"), F.concat_ws("::", "caller_module", "caller_function").alias("name")).agg(F.count("*").alias("outgoing"))
    rest = by_module(edges, by).join(own.select(*by, "module").distinct(), [*by, "module"], "left_anti").select(*by, "module", F.col("module").alias("name"), F.lit(0).cast("bigint").alias("outgoing"))
    return own.unionByName(rest)


def function_rows(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, module, function, file, line, outgoing): distinct callee modules of each function, told apart by module, name and line,
    and a row without function for each module that no function row covers.

    Such a module has no outgoing edges of its own, unless no edge of the snapshot names a function: then its rows are the modules with theirs.
    The file is that of the caller, the least one if it differs; for modules the least file at either end, ``<codebase>`` if there is none.
    """
    crossing = edges.filter(F.col("caller_module") != F.col("callee_module"))
    line = (F.col("caller_line") if "caller_line" in edges.columns else F.lit(0)).cast("bigint")
    file = (F.col("caller_file") if "caller_file" in edges.columns else F.lit(None)).cast("string")
    calls = crossing.filter(F.col("caller_function") != "").select(*by, F.col("caller_module").alias("module"), F.col("caller_function").alias("function"), line.alias("line"), file.alias("file"), "callee_module")
    # distinct before the count, with the least file: a function of any number of calls is one row per callee module and task
    own = calls.groupBy(*by, "module", "function", "line", "callee_module").agg(F.min("file").alias("file"))
    own = own.groupBy(*by, "module", "function", "line").agg(F.min("file").alias("file"), F.count("*").alias("outgoing"))
    ends = [F.struct(F.col(f"{x}_module").alias("module"), (F.col(f"{x}_file") if f"{x}_file" in edges.columns else F.lit(None)).cast("string").alias("file")) for x in ("caller", "callee")]
    files = crossing.select(*by, F.explode(F.array(*ends)).alias("x")).groupBy(*by, F.col("x.module").alias("module")).agg(F.min("x.file").alias("file"))
    rest = by_module(edges, by).join(own.select(*by, "module").distinct(), [*by, "module"], "left_anti").join(files, [*by, "module"])
    named = own.select(*by).distinct().withColumn("_named", F.lit(True)) if by else own.limit(1).select(F.lit(True).alias("_named"))
    rest = rest.join(named, list(by), "left") if by else rest.join(F.broadcast(named), how="left")
    none = F.lit(None).cast("string")
    rest = rest.select(*by, "module", none.alias("function"), F.lit(0).cast("bigint").alias("line"), "file", F.when(F.col("_named"), F.lit(0)).otherwise(F.col("outgoing")).cast("bigint").alias("outgoing"))
    out = own.select(*by, "module", "function", "line", "file", "outgoing").unionByName(rest)
    return out.withColumn("file", F.coalesce("file", F.lit("<codebase>")))


def first_file(edges: DataFrame, order: str) -> DataFrame:
    """(module, file): the first file seen for a module, as caller or callee; ties by ``order``, callers first."""
    both = edges.select(F.explode(F.array(F.struct(F.col("caller_module").alias("module"), F.col("caller_file").alias("file"), F.col(order).alias("o"), F.lit(0).alias("side")), F.struct(F.col("callee_module").alias("module"), F.col("callee_file").alias("file"), F.col(order).alias("o"), F.lit(1).alias("side")))).alias("x")).select("x.*")
    return both.groupBy("module").agg(F.min_by("file", F.struct("o", "side", "file")).alias("file"))
