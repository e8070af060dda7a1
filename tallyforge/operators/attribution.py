"""How much each item is responsible for a loss: exact counterfactuals from sums, without re-aggregating per item.

For an item, its score is set to 1, everything is aggregated again and the gain of the composite is the item's
responsibility. Each aggregation has a closed form over group sums, so one pass of mergeable aggregates and one join by
group replace a full re-evaluation per item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import LOSS_TOLERANCE, clamp01, has_loss, size_weight
from ..policy import Aggregation
from .aggregates import geometric_mean, tail_sums


def _sums(df: DataFrame, group: Sequence[str], exprs: dict[str, Column], key: Sequence[str] | None = None) -> DataFrame:
    """Group sums joined back to the rows: the sums aggregate partially, so a hot group costs nothing extra; the join is
    broadcast or split by adaptive execution where one group dominates."""
    sums = df.groupBy(*(key or group)).agg(*[e.alias(n) for n, e in exprs.items()])
    return df.join(sums, list(key or group)) if (key or group) else df.crossJoin(F.broadcast(sums))


def counterfactual_scores(df: DataFrame, group: Sequence[str], policy: Aggregation, score: str = "score", file: str = "file", size: str = "size_hint") -> DataFrame:
    """``df`` with ``dimension_score`` of its group and ``cf``, the group's score if this item's were 1."""
    df = df.filter(F.col(score).isNotNull())
    s = F.col(score)
    l = 1.0 - s  # noqa: E741
    n = F.col("_n")
    if policy.kind == "geometric_mean_score":
        out = _sums(df, group, {"_n": F.count("*"), "_z": F.count_if(s <= 0), "_s": F.coalesce(F.sum(F.ln(F.when(s > 0, s))), F.lit(0.0))})
        here = F.when(F.col("_z") > 0, F.lit(0.0)).otherwise(F.exp(F.col("_s") / n))
        cf = F.when(s > 0, F.when(F.col("_z") > 0, F.lit(0.0)).otherwise(F.exp((F.col("_s") - F.ln(F.when(s > 0, s))) / n)))
        cf = cf.otherwise(F.when(F.col("_z") > 1, F.lit(0.0)).otherwise(F.exp(F.col("_s") / n)))
    elif policy.kind == "arithmetic_mean_score":
        out = _sums(df, group, {"_n": F.count("*"), "_s": F.sum(s)})
        here, cf = F.col("_s") / n, (F.col("_s") + 1.0 - s) / n
    elif policy.kind == "power_mean_loss":
        p = max(policy.p, 1.0)
        out = _sums(df, group, {"_n": F.count("*"), "_s": F.sum(F.pow(l, F.lit(p)))})
        root = lambda x: clamp01(1.0 - F.pow(F.greatest(x, F.lit(0.0)) / n, F.lit(1.0 / p)))
        here, cf = root(F.col("_s")), root(F.col("_s") - F.pow(l, F.lit(p)))
    elif policy.kind == "mean_plus_cvar_loss":
        # equal losses at the border need no ranks: inside or outside the tail they give the same counterfactual
        sums = tail_sums(df, group, score, policy.alpha).select(*group, F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("loss").alias("_s"), F.col("tail").alias("_t"), F.col("border").alias("_b"), F.col("next").alias("_next"))
        out = df.join(sums, list(group)) if group else df.crossJoin(F.broadcast(sums))
        k = F.col("_k")
        tail = F.when(l >= F.col("_b"), (F.col("_t") - l + F.col("_next")) / k).otherwise(F.col("_t") / k)
        here = clamp01(1.0 - (F.col("_s") / n + policy.tail_weight * F.col("_t") / k))
        cf = clamp01(1.0 - ((F.col("_s") - l) / n + policy.tail_weight * tail))
    elif policy.kind == "hierarchical_file_weighted_mean_loss":
        df = df.withColumn("_w", size_weight(F.col(size), policy.size_weighting))
        files = df.groupBy(*group, file).agg(F.sum("_w").alias("_fw"), F.sum(l * F.col("_w")).alias("_fl"), F.sum(F.greatest(F.col(size).cast("double"), F.lit(1.0))).alias("_size"))
        files = files.withColumn("_outer", size_weight(F.col("_size"), policy.size_weighting)).drop("_size")
        tops = files.groupBy(*group).agg(F.sum("_outer").alias("_all"), F.sum(F.col("_outer") * F.col("_fl") / F.col("_fw")).alias("_sum"))
        files = files.join(tops, list(group)) if group else files.crossJoin(F.broadcast(tops))
        out = df.join(files, [*group, file])
        whole = F.col("_sum") / F.col("_all")
        here = clamp01(1.0 - whole)
        cf = clamp01(1.0 - (whole - F.col("_outer") / F.col("_all") * F.col("_w") * l / F.col("_fw")))
    else:
        raise ValueError(f"unknown aggregation {policy.kind!r}")
    out = out.withColumn("dimension_score", here).withColumn("cf", cf)
    return out.drop("_n", "_z", "_s", "_t", "_next", "_b", "_k", "_w", "_fw", "_fl", "_outer", "_all", "_sum")


def composite_with(others: DataFrame, on: Sequence[str], kind: str = "geometric_mean_score") -> DataFrame:
    """(on, _others, _count): what the other dimensions contribute to the composite, so that one can be replaced."""
    s = F.col("score")
    if kind == "geometric_mean_score":
        part = F.when(F.count(s) == 0, F.lit(0.0)).when(F.min(s) <= 0, F.lit(None).cast("double")).otherwise(F.sum(F.ln(F.when(s > 0, s))))
    else:
        part = F.coalesce(F.sum(s), F.lit(0.0))
    return others.groupBy(*on).agg(part.alias("_others"), F.count(s).alias("_count"))


def replace_in_composite(score: Column, kind: str = "geometric_mean_score") -> Column:
    """The composite with ``score`` next to ``_others``; 0 if any of them is 0 (geometric)."""
    if kind == "geometric_mean_score":
        return F.when(F.col("_others").isNull() | (score <= 0), F.lit(0.0)).otherwise(F.exp((F.col("_others") + F.ln(F.when(score > 0, score))) / (F.col("_count") + 1)))
    return (F.col("_others") + score) / (F.col("_count") + 1)


def itemized_heatmap(df: DataFrame, group: Sequence[str], policy: Aggregation, others: DataFrame | None = None, kind: str = "geometric_mean_score", **columns) -> DataFrame:
    """The lossy items of a dimension with their ``responsibility``; items below the tolerance are dropped.

    ``others`` is the output of ``composite_with`` for the remaining dimensions; without it the dimension is the composite.
    """
    score = columns.get("score", "score")
    cf = counterfactual_scores(df, group, policy, **columns).filter(has_loss(F.col(score)))
    if others is None:
        gain = F.col("cf") - F.col("dimension_score")
    else:
        cf = cf.join(others, list(group)) if group else cf.crossJoin(F.broadcast(others))
        gain = replace_in_composite(F.col("cf"), kind) - replace_in_composite(F.col("dimension_score"), kind)
    return cf.withColumn("responsibility", gain).filter(F.col("responsibility") >= LOSS_TOLERANCE).drop("cf", "dimension_score", "_others", "_count")


def equal_share_heatmap(items: DataFrame, group: Sequence[str], dimension: DataFrame, others: DataFrame, kind: str = "geometric_mean_score", weight: str | None = None, least: float | None = None) -> DataFrame:
    """A global dimension's responsibility in equal shares over its violating items; zero shares are kept.

    ``dimension`` has one (group, score) row; ``weight`` names a column for rows that stand for several items. Groups
    whose whole gain is below ``least`` are left out.
    """
    w = F.col(weight) if weight else F.lit(1)
    counts = items.groupBy(*group).agg(F.sum(w).alias("_items"))
    top = dimension.join(others, list(group)).join(counts, list(group)) if group else dimension.crossJoin(others).crossJoin(counts)
    gain = replace_in_composite(F.lit(1.0), kind) - replace_in_composite(F.col("score"), kind)
    if least is not None:
        top = top.filter(gain >= least)
    share = top.select(*group, F.when(F.col("_items") > 0, gain / F.col("_items")).otherwise(0.0).alias("_share"))
    out = items.join(share, list(group)) if group else items.crossJoin(F.broadcast(share))
    return out.withColumn("responsibility", F.col("_share") * w).drop("_share")


def whole_share(dimension: DataFrame, others: DataFrame, name: str, group: Sequence[str] = (), kind: str = "geometric_mean_score") -> DataFrame:
    """One ``<codebase>`` row that carries the whole responsibility of a dimension without items, where it has any loss."""
    top = dimension.join(others, list(group)) if group else dimension.crossJoin(F.broadcast(others))
    gain = replace_in_composite(F.lit(1.0), kind) - replace_in_composite(F.col("score"), kind)
    return top.filter(has_loss(F.col("score"))).select(*group, F.lit("<codebase>").alias("file"), F.lit(0).cast("bigint").alias("line"), F.lit("<codebase>").alias("function_name"), F.lit(name).alias("dimension"), gain.alias("responsibility")).filter(F.col("responsibility") >= LOSS_TOLERANCE)


def heatmap_order() -> list[Column]:
    """The total order of heatmap rows."""
    return [F.col("responsibility").desc(), F.col("dimension"), F.col("file"), F.col("line"), F.col("function_name")]


def top_per_label(df: DataFrame, label: str, n: int) -> DataFrame:
    """The first ``n`` rows of each label; the limit is applied before the shuffle (window group limit)."""
    w = Window.partitionBy(label).orderBy(*heatmap_order())
    return df.withColumn("position", F.row_number().over(w).cast("bigint")).filter(F.col("position") <= n)


def dimension_totals(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Sum and number of rows by dimension."""
    return df.groupBy(*group, "dimension").agg(F.sum("responsibility").alias("total"), F.count("*").alias("entries"))


__all__ = ["composite_with", "counterfactual_scores", "dimension_totals", "equal_share_heatmap", "geometric_mean", "heatmap_order", "itemized_heatmap", "replace_in_composite", "top_per_label"]
