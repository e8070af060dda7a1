"""One ranking from scores on unlike scales, as the stationary distribution of a walk over ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..session import Scratch, shared_folder


def in_order(df: DataFrame, by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``block`` and ``place``: the range partition of each row in the order of ``by``, and its place, which
    rises with the order. ``by`` should be unique, so that no key can fill a partition."""
    spark = df.sparkSession
    shared_folder(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(partitions, *by).sortWithinPartitions(*by).checkpoint()
    return sorted_.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place"))


def numbered(df: DataFrame, by: Sequence[F.Column | str], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with its position from 1 in the order of ``by``, without gathering the rows in one task."""
    cols = [c if isinstance(c, str) else f"_k{i}" for i, c in enumerate(by)]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(by, cols) if not isinstance(c, str)])
    placed = in_order(keyed, cols)
    # one row per partition
    before = placed.groupBy("block").agg(F.count("*").alias("c"), F.min("place").alias("first"))
    before = before.select("block", "first", (F.sum("c").over(Window.orderBy("block")) - F.col("c")).alias("before"))
    out = placed.join(F.broadcast(before), "block").withColumn(name, F.col("before") + F.col("place") - F.col("first") + 1)
    return out.select(*df.columns, name)


def _units(cells: DataFrame) -> pd.DataFrame:
    """One row per (score, block): its levels and rows, the values at its ends, and where a level that began earlier began.

    There are at most as many units as partitions and scores together; only they come to the driver.
    """
    levels = cells.groupBy("score", "block", "r").agg(F.first("v").alias("v"), F.count("*").alias("c"))
    one = F.max(F.struct("r", "v", "c")).alias("top")
    u = levels.groupBy("score", "block").agg(F.sum("c").alias("n"), F.min(F.struct("r", "v", "c")).alias("low"), one)
    u = u.select("score", "block", "n", F.col("low.v").alias("v_low"), F.col("low.c").alias("c_low"), F.col("top.r").alias("last"), F.col("top.v").alias("v_top"), F.col("top.c").alias("c_top"))
    u = u.toPandas().sort_values(["score", "block"], ignore_index=True)
    began: dict[tuple, int] = {}
    size: dict[tuple, int] = {}
    head = []
    for i, x in enumerate(u.itertuples(index=False)):
        low, top = (x.score, x.v_low), (x.score, x.v_top)
        head.append(began.get(low, -1))
        began.setdefault(top, i)
        size[low] = size.get(low, 0) + x.c_low
        if x.last > 1:
            size[top] = size.get(top, 0) + x.c_top
    u["head"] = head  # the unit in which the lowest level began, -1 if it begins here
    u["low_size"] = [size[k] for k in zip(u.score, u.v_low)]
    u["top_size"] = [size[k] for k in zip(u.score, u.v_top)]
    return u


def _below(u: pd.DataFrame, total: np.ndarray, under_top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit: what lies below it, and what lies below its lowest level; ``under_top`` is what a unit holds below its highest."""
    before = np.cumsum(total) - total
    first = np.r_[True, u.score.to_numpy()[1:] != u.score.to_numpy()[:-1]] if len(u) else np.empty(0, bool)
    off = before - before[np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))] if len(u) else before
    head = u["head"].to_numpy()
    return off, np.where(head >= 0, off[head] + under_top[head], off)


def rank_walk(scores: DataFrame, item: str, score: str, value: str, names: Sequence[str], damping: float = 0.5, tolerance: float | None = None, most_steps: int = 200) -> DataFrame:
    """(item, weight, position): all items that have every score of ``names``, best first; higher values are better.

    The walk: from an item pick one of the scores and then any item; jump there if it stands higher in that score, else
    stay; with probability ``1 - damping`` start anew anywhere. Only the order within a score counts, whatever its range, and
    all scores weigh the same. One step moves to each item the mass of all lower ones: a prefix sum over each sorted score.

    The scores are sorted once, into blocks of equal numbers of rows; an item keeps its places. A step sends (place, mass) to
    the blocks, sums inside them, adds what lies in the blocks below, and sends the sums back to the items: two shuffles. The totals
    of the blocks, one row each, are added up on the driver. A value that most items share spreads over as many
    blocks as it needs, so neither it nor a score's whole column is ever in one task. Steps repeat until no item's weight moves by more than
    ``tolerance / n``; by default a thousandth of what one place in one score is worth, so positions no longer change. If ``most_steps`` do not
    suffice, that is an error.

    Null and NaN values are missing; infinite values rank as such; items with a missing score are left out; equal values
    stand level; a repeated (item, score) row counts once (the largest value if they differ); scores outside ``names`` are
    ignored; an empty table gives an empty result. Weights are rounded, in units
    of 1/n, to nine digits or as many more as one place needs (twelve at most), as sums come in any order; items that then agree are placed by their id.
    """
    spark = scores.sparkSession
    scratch = Scratch(spark)
    m = len(names)
    rows = scores.filter(F.col(item).isNotNull() & F.col(score).isin(list(names)) & F.col(value).isNotNull() & ~F.isnan(value))
    rows = rows.groupBy(F.col(item).alias("item"), F.col(score).alias("score")).agg((F.max(F.col(value).cast("double")) + F.lit(0.0)).alias("v"))
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("score")).cast("int")
    complete = rows.groupBy("item").agg(F.count("*").alias("c"), F.collect_list(F.struct(number.alias("score"), "v")).alias("vs")).filter(F.col("c") == m)
    # items travel as numbers, given once and written
    wide = scratch.save(complete.select("item", F.monotonically_increasing_id().alias("i"), "vs"))
    n = wide.count()
    kind = wide.schema["item"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"item {kind}, weight double, position bigint").withColumnRenamed("item", item)

    unit_weight = 1e-3 / (n * m)
    tolerance = unit_weight if tolerance is None else tolerance
    placed = in_order(wide.select("i", F.explode("vs").alias("s")).select("i", "s.score", "s.v"), ["score", "v", "i"])
    unit = Window.partitionBy("score", "block").orderBy("v")
    cells = scratch.save(placed.select("i", "score", "v", "block", F.dense_rank().over(unit).alias("r"), F.count("*").over(unit).alias("upto")))
    u = _units(cells)
    number = np.arange(len(u), dtype=np.int64)

    def known(**columns: np.ndarray) -> DataFrame:
        return F.broadcast(spark.createDataFrame(pd.DataFrame({"u": number, **columns})))

    count, top = u["n"].to_numpy(), u["c_top"].to_numpy()
    off, low = _below(u, count, count - top)
    # rows at or below a level: those of a level at the end of a unit may stand in other units, too
    ends = known(score=u["score"].to_numpy(), block=u["block"].to_numpy(), last=u["last"].to_numpy(), off=off, at_low=low + u["low_size"].to_numpy(), at_top=np.where(u["last"] > 1, off + count - top, low) + u["top_size"].to_numpy())
    level = F.when(F.col("r") == 1, F.col("at_low")).when(F.col("r") == F.col("last"), F.col("at_top")).otherwise(F.col("off") + F.col("upto"))
    # a place is one number: unit, level, and whether the level is below the unit's highest
    place = F.call_function("shiftleft", F.col("u"), F.lit(40)) + F.col("r") * 2 + (F.col("r") < F.col("last")).cast("bigint")
    walk = cells.join(ends, ["score", "block"]).groupBy("i").agg(F.collect_list(place).alias("at"), F.sum(level).alias("not_above"))
    walk = scratch.save(walk.select("i", F.lit(1.0 / n).alias("p"), "not_above", "at"))
    for _ in range(most_steps):
        out = walk.select("i", "p", F.explode("at").alias("c"))
        sums = out.groupBy(F.shiftright("c", 40).alias("u")).agg(F.sum("p").alias("t"), F.sum(F.when(F.col("c") % 2 == 1, F.col("p")).otherwise(0.0)).alias("inner")).toPandas()
        sums = sums.set_index("u").reindex(number)
        off, low = _below(u, sums["t"].to_numpy(), sums["inner"].to_numpy())
        cell = out.select("i", "p", F.shiftright("c", 40).alias("u"), F.shiftright(F.col("c").bitwiseAND((1 << 40) - 1), 1).alias("r"))
        inside = F.sum("p").over(Window.partitionBy("u").orderBy("r").rangeBetween(Window.unboundedPreceding, -1))
        met = cell.select("i", "u", "r", inside.alias("inside")).join(known(off=off, low=low), "u")
        under = met.groupBy("i").agg(F.sum(F.when(F.col("r") == 1, F.col("low")).otherwise(F.col("off") + F.col("inside"))).alias("q"))
        p = F.lit((1 - damping) / n) + (F.col("q") + F.col("p") * F.col("not_above")) * F.lit(damping / (n * m))
        step = walk.join(under, "i").select("i", F.col("p").alias("was"), p.alias("p"), "not_above", "at")
        seen = Observation()
        nxt = scratch.save(step.observe(seen, F.max(F.abs(F.col("p") - F.col("was"))).alias("moved")).drop("was"))
        scratch.free(walk)
        walk = nxt
        if seen.get["moved"] * n < tolerance:
            break
    else:
        raise RuntimeError(f"the walk did not settle in {most_steps} steps")
    walk = walk.select("i", "p").join(wide.select("i", "item"), "i")
    weight = F.round(F.col("p") * F.lit(float(n)), min(12, max(9, math.ceil(-math.log10(unit_weight)))))
    ranked = numbered(walk.select("item", (weight / F.lit(float(n))).alias("weight")), [-F.col("weight"), "item"], "position", scratch)
    return ranked.select(F.col("item").alias(item), "weight", "position")
