"""The stated orders of outputs, as sorting columns for ``orderBy`` or ``delivery.numbered``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def entropy_order(normalized: str = "normalized", item: str = "path") -> list[Column]:
    """Lowest normalized entropy first."""
    return [F.col(normalized), F.col(item)]


def group_order(length: str = "shape_length", key: str = "first") -> list[Column]:
    """Longest groups first, then by their key."""
    return [F.col(length).desc(), F.col(key)]


def pair_order(similarity: str = "similarity", a: Sequence[str] = ("file", "line", "name"), last: Sequence[str] = ()) -> list[Column]:
    """Most alike first, then by the place of the first end; ``last`` settles what is left."""
    return [F.col(similarity).desc(), *[F.col(c) for c in (*a, *last)]]


def place_order(*last: str) -> list[Column]:
    """By file, line and name."""
    return [F.col(c) for c in ("file", "line", "name", *last)]


def change_order(keys: Sequence[str], delta: str = "delta") -> list[Column]:
    """Greatest change first, whatever its sign, then by key."""
    return [F.abs(F.col(delta)).desc(), *[F.col(k) for k in keys]]


def vector_order() -> list[Column]:
    """A loss vector is delivered by name."""
    return [F.col("name")]
