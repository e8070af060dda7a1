"""Set algebra over arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ngrams(tokens: Column, n: int = 3) -> Column:
    """The distinct runs of ``n`` consecutive elements; empty if there are fewer."""
    some = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.slice(tokens, i + 1, n))
    none = F.slice(F.array(tokens), 2, 1)
    return F.when(F.size(tokens) >= n, F.array_distinct(some)).otherwise(none)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def run_hashes(tokens: Column, n: int = 3) -> Column:
    """64-bit hashes of the distinct runs of ``n`` tokens; comparing numbers is far cheaper than comparing arrays."""
    some = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.xxhash64(*[F.element_at(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<bigint>"))
