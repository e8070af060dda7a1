"""Reports, policies and semantic data as JSON, and text renderings of heatmaps and trees."""

from __future__ import annotations

import difflib
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schema
from ..functions.text import scope_label


def read_semantic(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three relations of a semantic JSON file; missing arrays are empty."""
    raw = spark.read.schema(schema.SEMANTIC).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return {n: raw.select(F.explode(n).alias("x")).select("x.*") for n in ("type_cardinalities", "function_cardinalities", "call_edges")}


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON Lines of one relation (``functions``, ``types``, ``observations``, ``heatmap``, ``fingerprints``); missing fields are NULL."""
    return spark.read.schema(getattr(schema, kind.upper())).option("mode", "FAILFAST").json(path)


def write_rows(df: DataFrame, path: str) -> None:
    """One JSON object per line, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


def find_upwards(start: str | Path, name: str, levels: int = 32) -> Path | None:
    """The nearest ``name`` in ``start`` or one of its parents."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][:levels]:
        if (folder / name).exists():
            return folder / name
    return None


def heatmap_summary(heat: DataFrame, dimensions: DataFrame, composite: DataFrame, top: int = 20) -> DataFrame:
    """One JSON document: composite loss, dimensions with their losses, totals, and the first rows. Bounded by ``top``."""
    from ..operators.attribution import dimension_totals, heatmap_order

    first = heat.orderBy(*heatmap_order()).limit(top).select("responsibility", "dimension", "file", "line", "function_name")
    first = first.agg(F.sort_array(F.collect_list(F.struct((-F.col("responsibility")).alias("o"), "dimension", "file", "line", "function_name"))).alias("x"))
    first = first.select(F.transform("x", lambda r: F.struct((-r["o"]).alias("responsibility"), r["dimension"].alias("dimension"), r["file"].alias("file"), r["line"].alias("line"), r["function_name"].alias("function_name"))).alias("entries"))
    status = F.when((F.col("dimension") == "coupling_density") & (F.col("item_count") == 0), "not_measured").otherwise("measured")
    dims = dimensions.agg(F.sort_array(F.collect_list(F.struct("dimension", (1.0 - F.col("score")).alias("loss"), "item_count", status.alias("status")))).alias("dimensions"))
    totals = dimension_totals(heat).agg(F.sort_array(F.collect_list(F.struct("dimension", "total", "entries"))).alias("totals"))
    out = composite.select((1.0 - F.col("score")).alias("composite_loss")).crossJoin(dims).crossJoin(totals).crossJoin(first)
    return out.select(F.to_json(F.struct("*")).alias("value"))


def flat_lines(heat: DataFrame, top: int = 50) -> DataFrame:
    """Text lines of the first rows: a header whenever the file changes from the row before, and a bar of ten cells."""
    from ..operators.attribution import heatmap_order

    first = heat.orderBy(*heatmap_order()).limit(top)
    w = Window.orderBy(*heatmap_order())  # over at most ``top`` rows
    bar = F.repeat(F.lit("@"), F.least(F.round(10 * F.col("responsibility")), F.lit(10.0)).cast("int"))
    rows = first.withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("file").over(w))
    line = F.concat(F.lit("  "), F.rpad(bar, 10, "."), F.lit(" "), F.format_number("responsibility", 4), F.lit(" "), F.col("function_name"), F.lit(":"), F.col("line").cast("string"), F.lit(" ["), F.col("dimension"), F.lit("]"))
    head = F.when(F.col("before").eqNullSafe(F.col("file")), F.array(line)).otherwise(F.array(F.col("file"), line))
    return rows.select("n", F.posexplode(head).alias("k", "line")).orderBy("n", "k").select("line")


def tree_lines(ordered: DataFrame) -> DataFrame:
    """Text lines of a tree in pre-order (``rollup.pre_order``), with connectors."""
    depth = F.size("path")
    own = F.concat(F.when(F.col("last"), "`-- ").otherwise("|-- "), scope_label(F.element_at("path", -1)), F.lit(" "), F.format_number("responsibility", 4))
    return ordered.orderBy("ids").select(F.concat(F.repeat(F.lit("|   "), (depth - 1).cast("int")), own).alias("line"))


def with_label(frames: dict[str, DataFrame]) -> DataFrame:
    """Several targets as one frame: ``label`` tells them apart and leads every file."""
    out = None
    for label, df in frames.items():
        one = df.withColumn("label", F.lit(label)).withColumn("file", F.concat(F.lit(label + "/"), F.col("file")))
        out = one if out is None else out.unionByName(one)
    return out


def catalog(spark: SparkSession) -> DataFrame:
    """(name, aggregation, rule) of the five dimensions."""
    rows = [
        ("duplication", "global", "1 - share of functions in a duplicate group or near pair"),
        ("code_economy", "global", "production functions over public surface"),
        ("state_cardinality", "per type and function", "log2 of reachable states"),
        ("bloat", "per function", "log2 of code lines"),
        ("coupling_density", "per module", "outgoing cross-module edges"),
    ]
    return spark.createDataFrame(rows, "name string, aggregation string, rule string")


def policy_json(policy) -> str:
    return json.dumps(policy.to_dict(), indent=2)


def wrap(text: str, width: int = 80, indent: str = "") -> list[str]:
    """Greedy word wrap with a hanging indent."""
    out, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            out.append(line)
            line = indent + word
        else:
            line = f"{line} {word}" if line else word
    return [*out, line] if line else out


def snippet(files: DataFrame, path: str) -> DataFrame:
    """(number, line) of one file; the filter reaches the scan."""
    from ..functions.text import lines

    return files.filter(F.col("path") == path).select(F.posexplode(lines(F.col("content"))).alias("number", "line")).withColumn("number", F.col("number") + 1)


def component_path_order(path: Column) -> Column:
    """Sorting key that compares paths by component."""
    return F.split(path, "/")


def text_diff(before: Column, after: Column) -> Column:
    """Unified line diff of two texts; empty if they are equal. Arrow batches, for rendered frames and snippets."""
    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "expected", "actual", lineterm="")) for x, y in zip(a, b)])

    return diff(before, after)


def compare(before, after) -> dict[str, DataFrame]:
    """All differences of two ``plans.snapshot.Report``s: summary, heatmap, dimensions, strict loss deltas."""
    from ..operators import diffs

    return {
        "summary": diffs.diff_summaries(before.summary, after.summary),
        "heatmap": diffs.diff_heatmaps(before.heatmap, after.heatmap),
        "dimensions": diffs.diff_dimensions(before.scored.dimensions, after.scored.dimensions),
        "loss_delta": diffs.strict_loss_delta(before.scored.dimensions, after.scored.dimensions),
    }


#: The relations of a report that are stored; each is a table of its own.
STORED = ("summary", "entropy_files", "entropy_total", "duplication", "observations", "dimensions", "composite", "heatmap")


def save(report, folder: str) -> None:
    """Write a ``plans.snapshot.Report``, one table per relation; what stood there is replaced."""
    frames = {c: getattr(report, c) for c in ("summary", "entropy_files", "entropy_total", "duplication", "heatmap")}
    frames |= {c: getattr(report.scored, c) for c in ("observations", "dimensions", "composite")}
    for name in STORED:
        frames[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str):
    """A stored report, to be shown or compared like a fresh one; its sources are not part of it. A missing relation is an error."""
    from ..plans import dimensions, snapshot

    t = {name: spark.read.parquet(f"{folder}/{name}") for name in STORED}
    scored = dimensions.Scored(t["observations"], t["dimensions"], t["composite"])
    return snapshot.Report(None, t["summary"], t["entropy_files"], t["entropy_total"], t["duplication"], scored, t["heatmap"])
