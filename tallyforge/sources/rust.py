"""Rust source trees as relations: one row per file, then functions, types and fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema
from .rust_measure import RustSyntaxError, code_lines, measure_file

MEASURED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("total_lines", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("macros", T.LongType()),
        T.StructField("exported", T.LongType()),
        T.StructField("functions", T.ArrayType(schema.FUNCTIONS)),
        T.StructField("types", T.ArrayType(schema.TYPES)),
        T.StructField("fingerprints", T.ArrayType(schema.FINGERPRINTS)),
    ]
)


def read_files(spark: SparkSession, path: str, glob: str = "*.rs") -> DataFrame:
    """(path, content) of a single file, whatever its name, or of all matching files below a folder."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if not path.endswith(".rs"):
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"]):
            text = content or ""
            row = {"path": path, "total_lines": code_lines(text), "error": None, "macros": 0, "exported": 0, "functions": [], "types": [], "fingerprints": []}
            try:
                found = measure_file(text, path)
                for t in found["types"]:
                    t["state_cardinality"] = Decimal(t["state_cardinality"])
                row |= found
            except (RustSyntaxError, IndexError, RecursionError) as e:
                row["error"] = str(e) or type(e).__name__
            rows.append(row)
        yield pd.DataFrame(rows, columns=MEASURED.fieldNames())


@dataclass
class Snapshot:
    """The relations of one source tree. All are views of one measured table; persist ``measured`` to parse once."""

    measured: DataFrame

    @property
    def files(self) -> DataFrame:
        """(path, total_lines, error): a file that can't be parsed still has its lines."""
        return self.measured.select("path", "total_lines", "error")

    @property
    def functions(self) -> DataFrame:
        return self.measured.select(F.explode("functions").alias("x")).select("x.*")

    @property
    def types(self) -> DataFrame:
        return self.measured.select(F.explode("types").alias("x")).select("x.*")

    @property
    def fingerprints(self) -> DataFrame:
        return self.measured.select(F.explode("fingerprints").alias("x")).select("x.*")

    @property
    def macros(self) -> DataFrame:
        """(macros, exported, production_lines, files_analyzed) over the whole tree."""
        parsed = F.col("error").isNull()
        return self.measured.agg(F.sum("macros").alias("macros"), F.sum("exported").alias("exported"), F.sum(F.when(parsed, F.col("total_lines"))).alias("production_lines"), F.count_if(parsed).alias("files_analyzed"))


def snapshot(files: DataFrame) -> Snapshot:
    """Measure a (path, content) table. Parsing runs where the files are read; nothing is shuffled."""
    return Snapshot(files.select("path", "content").mapInPandas(_measure, MEASURED))


def definition_line(content: F.Column, offset: F.Column) -> F.Column:
    """Line of a character offset, from 1."""
    before = F.substr(content, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def relative_path(path: F.Column, root: str) -> F.Column:
    """``path`` without the workspace's prefix; kept as it is outside of it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def local_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct call edges whose callee is a known module other than the caller's."""
    known = modules.select(F.col("module").alias("callee_module")).distinct()
    return edges.filter(F.col("caller_module") != F.col("callee_module")).join(known, "callee_module", "left_semi").distinct()
