"""Fuzzy subsequence scores and first matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The scores of a matched character, of one at a word's start, of one right after the last, of a match at the very start.
EACH, WORD_START, CONTIGUOUS, PREFIX = 1, 5, 3, 10
SEPARATORS = (" ", "-", "_")


def fuzzy_score(query: str, candidate: Column) -> Column:
    """Score of the leftmost subsequence match, ignoring case; NULL if there is none; 0 for an empty query."""
    if not query:
        return F.lit(0).cast("bigint")
    text = F.lower(candidate)
    chars = F.array(*[F.lit(c) for c in query.lower()])

    def step(acc: Column, c: Column) -> Column:
        at = F.when(acc["at"] >= 0, F.call_function("locate", c, text, (acc["at"] + 1).cast("int"))).otherwise(0)
        before = F.substr(text, at - 1, F.lit(1))
        start = (at == 1) | before.isin(*SEPARATORS)
        gain = EACH + F.when(start, WORD_START).otherwise(0) + F.when((acc["at"] > 0) & (at == acc["at"] + 1), CONTIGUOUS).otherwise(0) + F.when((acc["at"] == 0) & (at == 1), PREFIX).otherwise(0)
        return F.struct(F.when(at > 0, at).otherwise(-1).cast("int").alias("at"), F.when(at > 0, acc["score"] + gain).otherwise(acc["score"]).cast("bigint").alias("score"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("score"))
    return F.aggregate(chars, zero, step, lambda acc: F.when(acc["at"] >= 0, acc["score"]))


def fuzzy_rank(df: DataFrame, query: str, candidate: str, order: str) -> DataFrame:
    """Matching rows, best first; an empty query keeps all rows in their order."""
    out = df.withColumn("score", fuzzy_score(query, F.col(candidate))).filter("score is not null")
    return out.orderBy(F.col("score").desc(), order)


def first_match(*cases: tuple[Column, Column]) -> Column:
    """The value of the first case whose guard holds and whose value is there."""
    return F.coalesce(*[F.when(guard, value) for guard, value in cases])
