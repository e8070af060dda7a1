"""Incremental refresh: keep one row per path, by content hash, and tell what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_events(spark: SparkSession, folder: str, glob: str = "*.rs", per_trigger: int | None = None) -> DataFrame:
    """A stream of (path, content, modified) of new files under a folder."""
    reader = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))


def changes(known: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) between two (path, content) tables: created, modified or deleted; only hashes meet in the join."""
    h = lambda df, n: df.select("path", F.sha2(F.col("content").cast("binary"), 256).alias(n))
    both = h(known, "a").join(h(now, "b"), "path", "full")
    status = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", status.alias("change")).filter("change is not null")


def watch(events: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, interval_ms: int = 300):
    """Start a query that hands each batch's latest row per path to ``refresh``. The trigger interval gathers bursts, as a debounce does."""

    def each(batch: DataFrame, n: int) -> None:
        refresh(batch.groupBy("path").agg(F.max_by("content", "modified").alias("content"), F.max("modified").alias("modified")), n)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{interval_ms} milliseconds").start()
