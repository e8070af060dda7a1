"""Token frequencies and Shannon entropy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import tokens


def token_counts(docs: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """(key, token, count) of every document, counted partially where the text is read."""
    return docs.select(*key, F.explode(tokens(F.col(text))).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("count"))


def entropy(counts: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key, total, vocabulary, entropy, normalized); both are 0 for a vocabulary of one.

    H = log2 N - sum(c log2 c) / N needs no total in advance, so one mergeable aggregate does it.
    """
    c = F.col("count")
    out = counts.groupBy(*key).agg(F.coalesce(F.sum(c), F.lit(0)).alias("total"), F.count("*").alias("vocabulary"), F.sum(c * F.log2(c)).alias("_s"))
    h = F.log2(F.col("total")) - F.col("_s") / F.col("total")
    many = F.col("vocabulary") > 1
    out = out.withColumn("entropy", F.when(many, F.greatest(h, F.lit(0.0))).otherwise(0.0))
    return out.withColumn("normalized", F.when(many, F.col("entropy") / F.log2("vocabulary")).otherwise(0.0)).drop("_s")


def pooled(counts: DataFrame) -> DataFrame:
    """Counts over all documents, from those of each."""
    return counts.groupBy("token").agg(F.sum("count").alias("count"))
