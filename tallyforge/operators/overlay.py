"""Lookup joins with an exact key first and a path-suffix match as fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch


def overlay_lookup(items: DataFrame, overlay: DataFrame, value: str, file: str = "file", module: str = "module_path", equal: Sequence[str] = ("name",), default: str | None = None) -> DataFrame:
    """``items`` with ``value`` from the overlay row of the same (file, module, equal...), else from the first row, in the order of
    (file, module), with equal ``equal`` columns whose file ends like the item's; else ``default``.

    The fallback is two equi-joins on ``equal`` and a whole path: the item's path with every tail of the stored paths, and every tail of
    the item's path with the stored paths. So nothing is paired that does not match, however many rows share a name and a last
    component. Items are numbered once and written, so both branches see the same numbers.
    """
    eq = list(equal)
    # a generated number is only a key if it is not generated again in each branch
    keyed = Scratch(items.sparkSession).save(items.withColumn("_id", F.monotonically_increasing_id()))
    exact = overlay.select(F.col(file).alias("_f"), F.col(module).alias("_m"), *[F.col(c).alias(f"_{c}") for c in eq], F.col(value).alias("_v"))
    exact = exact.groupBy("_f", "_m", *[f"_{c}" for c in eq]).agg(F.min("_v").alias("_v"))
    on = (F.col(file) == F.col("_f")) & (F.col(module) == F.col("_m"))
    for c in eq:
        on = on & (F.col(c) == F.col(f"_{c}"))
    found = keyed.join(exact, on, "left").drop("_f", "_m", *[f"_{c}" for c in eq])

    def tails(c: str) -> Column:
        """The path and what follows each of its slashes, without empty ones."""
        parts = F.split(c, "/")
        own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        return F.filter(own, lambda x: x != "")

    stored = overlay.filter(F.col(file).isNotNull()).select(F.col(file).alias("_f"), F.col(module).alias("_m"), *eq, F.col(value).alias("_w")).groupBy("_f", "_m", *eq).agg(F.min("_w").alias("_w"))
    open_ = found.filter(F.col("_v").isNull() & F.col(file).isNotNull()).select("_id", F.col(file).alias("_file"), *eq)
    within = stored.select("*", F.explode(tails("_f")).alias("_file")).join(open_, [*eq, "_file"])
    around = open_.select("_id", *eq, F.explode(F.slice(tails("_file"), 2, 1 << 30)).alias("_f")).join(stored, [*eq, "_f"])
    best = lambda df: df.groupBy("_id").agg(F.min(F.struct("_f", "_m", "_w")).alias("_b"))
    near = best(within).unionByName(best(around)).groupBy("_id").agg(F.min("_b").alias("_b")).select("_id", F.col("_b._w").alias("_w"))
    out = found.join(near, "_id", "left").withColumn(value if default is None else "_value", F.coalesce("_v", "_w", *([F.col(default)] if default else [])))
    return (out.drop("_id", "_v", "_w") if default is None else out.drop("_id", "_v", "_w").withColumnRenamed("_value", value))
