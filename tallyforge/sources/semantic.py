"""Relations of a resolving backend, once its output is ingested (``reports.read_semantic``)."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import reports


def select_source(spark: SparkSession, explicit: str | None = None, backend: str | None = None) -> dict[str, DataFrame]:
    """An explicit file wins, then the output of a backend; neither is an error that says so."""
    path = explicit or backend
    if not path:
        raise ValueError("no semantic data: name a file, or the output of a resolving backend")
    return reports.read_semantic(spark, path)


def batch_lookup(targets: DataFrame, resolved: DataFrame, value: str, path: str = "path", canonical: str = "canonical") -> DataFrame:
    """``targets`` with ``value`` found by the canonical path, else by the path as given, else null. ``resolved`` has (path, value);
    of a path with several rows the least value counts."""
    known = resolved.groupBy(F.col("path").alias("_p")).agg(F.min(value).alias("_v"))
    first = targets.join(known.withColumnRenamed("_v", "_a"), F.col(canonical) == F.col("_p"), "left").drop("_p")
    second = first.join(known.withColumnRenamed("_v", "_b"), F.col(path) == F.col("_p"), "left").drop("_p")
    return second.withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def visible_fields(fields: DataFrame, visibility: str = "visibility") -> DataFrame:
    """Fields that code outside of their module can see: those of module visibility, or of none stated, are left out."""
    return fields.filter(F.col(visibility).isNotNull() & ~F.col(visibility).isin("module", "private", ""))


def resolved_functions(bindings: DataFrame, by: Sequence[str] = ("file", "module_path", "name", "line"), states: str = "states") -> DataFrame:
    """(by, internal_state_cardinality_log2): log2 of the product of the states of a function's mutable bindings, plain identifiers
    only; functions with one state have no row. ``bindings`` has (by, pattern, states); a sum of logarithms merges partially."""
    rows = bindings.filter((F.col("pattern") == "ident") & (F.col(states) > 0))
    out = rows.groupBy(*by).agg(F.sum(F.log2(F.col(states).cast("double"))).alias("internal_state_cardinality_log2"))
    return out.filter(F.col("internal_state_cardinality_log2") > 0)


def subtree(rows: DataFrame, root: str, names: str | None = None, leave_out: Sequence[str] = ("std", "core", "alloc", "proc_macro", "test")) -> DataFrame:
    """Rows whose ``path`` lies under ``root``; with ``names`` also without the crates of ``leave_out``."""
    prefix = root.rstrip("/") + "/"
    out = rows.filter(F.col("path").startswith(prefix) | (F.col("path") == root.rstrip("/")))
    return out.filter(~F.col(names).isin(*leave_out)) if names else out


def resolve_path(path: str, start: str) -> str | None:
    """An absolute path as it is; else joined to the first ancestor of ``start`` under which it exists."""
    if Path(path).is_absolute():
        return path
    here = Path(start).absolute()
    return next((str(a / path) for a in (here, *here.parents) if (a / path).exists()), None)


def workspace_root(start: str) -> str:
    """The nearest folder at or above ``start`` whose manifest has a workspace table."""
    here = Path(start).absolute()
    for a in (here, *here.parents):
        manifest = a / "Cargo.toml"
        if manifest.is_file() and "[workspace]" in manifest.read_text():
            return str(a)
    raise FileNotFoundError(f"no workspace above {start}")


__all__ = ["batch_lookup", "resolve_path", "resolved_functions", "select_source", "subtree", "visible_fields", "workspace_root"]
