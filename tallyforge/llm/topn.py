"""The N best rows of every group, by bounded heaps that merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.internal import InternalFunction

from ..session import Scratch


def _usable(c: str, kind: str) -> Column:
    ok = F.col(c).isNotNull()
    return ok & ~F.isnan(c) if kind in ("double", "float") else ok


def _falling(c: Column, kind: str) -> Column:
    """``c`` in its own type, turned so that ascending order is falling: no value is rounded or overflows. Its own inverse."""
    return F.bitwise_not(c) if kind in ("bigint", "int", "smallint", "tinyint") else -c


def _again(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, position, o) of the first ``n`` different rows of each group. The rank is compared as it is, so that the limit is also
    applied in each task before the shuffle (window group limit); copies of these rows pass it and are merged, partially as well."""
    ranked = rows.distinct().select(*keys, "o", F.row_number().over(Window.partitionBy(*keys).orderBy("o")).alias("rank"))
    return ranked.filter(F.col("rank") <= n).select(*keys, (F.col("rank") - 1).alias("position"), "o")


def top_per_group(df: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], row_id: str, n: int = 3, slots: int | None = None) -> DataFrame:
    """The ``n`` rows of highest ``score`` of each group; equal scores are settled by ``ties`` and then ``row_id``, ascending.

    Each task keeps one heap of ``slots`` rows per group before the shuffle (a mergeable aggregate in the JVM), so a group
    of any size sends at most ``slots`` rows per task. A row delivered again has the same ``row_id`` and content; copies
    take up slots, so a group whose full heap holds fewer than ``n`` different rows is read again and ranked exactly,
    with the limit applied before its shuffle. No row is lost to copies, however many there are.

    Rows with a null or NaN group column or score are left out; nulls in ``ties`` stand first, strings compare by bytes;
    a group with fewer than ``n`` rows gives them all; an empty table gives an empty result. Other columns are ignored.
    Returns the group columns, score, ties, row_id and ``position`` (1 is best).
    """
    slots = slots or 2 * n
    if slots < n:
        raise ValueError("slots must be at least n")
    kinds = dict(df.dtypes)
    names = [*group, score, *ties, row_id]
    keys = [f"g{i}" for i in range(len(group))]
    order = F.struct(
        _falling(F.col(score), kinds[score]).alias("s"),
        *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)],
        F.col(row_id).alias("id"),
    )
    keep = _usable(score, kinds[score]) & F.col(row_id).isNotNull()
    for c in group:
        keep = keep & _usable(c, kinds[c])
    rows = df.filter(keep).select(*[F.col(c).alias(k) for c, k in zip(group, keys)], order.alias("o"))

    heaps = rows.groupBy(*keys).agg(InternalFunction.collect_top_k(F.col("o"), slots, True).alias("kept"))
    heaps = heaps.select(*keys, F.array_sort(F.array_distinct("kept")).alias("best"), (F.size("kept") == slots).alias("full"))
    heaps = Scratch(df.sparkSession).save(heaps)
    short = F.col("full") & (F.size("best") < n)
    found = heaps.filter(~short).select(*keys, F.posexplode(F.slice("best", 1, n)).alias("position", "o"))

    crowded = heaps.filter(short).select(*keys)
    if not crowded.isEmpty():
        found = found.unionByName(_again(rows.join(crowded, keys, "left_semi"), keys, n))
    return found.select(
        *[F.col(k).alias(c) for c, k in zip(group, keys)],
        _falling(F.col("o.s"), kinds[score]).alias(score),
        *[F.col(f"o.t{i}").alias(c) for i, c in enumerate(ties)],
        F.col("o.id").alias(row_id),
        (F.col("position") + 1).cast("bigint").alias("position"),
    ).select(*names, "position")
