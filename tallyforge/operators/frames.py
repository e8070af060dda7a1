"""Sequences of frames and series: change from frame to frame, coverage, smoothness, tails, levels, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def frame_deltas(df: DataFrame, series: str, order: str, cells: str, tolerance: float = 0.0) -> DataFrame:
    """(series, order, changed, total, largest) between each frame and the one before it; the first frame has no row.

    ``cells`` is an array of numbers of one length per series.
    """
    w = Window.partitionBy(series).orderBy(order)
    pair = df.select(series, order, F.col(cells).alias("_b"), F.lag(cells).over(w).alias("_a")).filter("_a is not null")
    d = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    pair = pair.select(series, order, d.alias("_d"))
    return pair.select(
        series, order, F.size(F.filter("_d", lambda x: x > tolerance)).cast("bigint").alias("changed"), F.aggregate("_d", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("_d").alias("largest")
    )


def smoothness(deltas: DataFrame, series: str, value: str = "total") -> DataFrame:
    """Population deviation over mean of the non-zero deltas; 0 for fewer than two."""
    v = F.when(F.col(value) != 0, F.col(value))
    return deltas.groupBy(series).agg(F.when(F.count(v) < 2, F.lit(0.0)).otherwise(F.stddev_pop(v) / F.avg(v)).alias("smoothness"))


def coverage(df: DataFrame, series: str, order: str, cells: str, tolerance: float = 0.0) -> DataFrame:
    """Share of cells that change at least once from one frame to the next."""
    w = Window.partitionBy(series).orderBy(order)
    pair = df.select(series, F.col(cells).alias("_b"), F.lag(cells).over(w).alias("_a"))
    moved = F.zip_with(F.coalesce("_a", "_b"), "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")) > tolerance)
    return pair.select(series, F.posexplode(moved).alias("cell", "m")).groupBy(series, "cell").agg(F.max("m").alias("m")).groupBy(series).agg(F.avg(F.col("m").cast("double")).alias("coverage"))


def periodicity(df: DataFrame, series: str, order: str, cells: str) -> DataFrame:
    """Mean distance of the cells of the first and the last frame; two argmaxes, no window."""
    ends = df.groupBy(series).agg(F.min_by(cells, order).alias("_a"), F.max_by(cells, order).alias("_b"))
    d = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return ends.select(series, (F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size("_a")).alias("distance"))


def tail(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group, with ``from_end`` (1 is last); limited before the shuffle."""
    w = Window.partitionBy(group).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("from_end", F.row_number().over(w).cast("bigint")).filter(F.col("from_end") <= n)


def levels(value: F.Column, most: F.Column, steps: int = 8) -> F.Column:
    """0..steps-1 in proportion to ``most``."""
    top = float(steps - 1)
    return F.when(most > 0, F.least(F.round(F.lit(top) * value / most), F.lit(top))).otherwise(0.0).cast("bigint")


def visible_window(df: DataFrame, group: str, order: str, width: str, selected: str, room: int) -> DataFrame:
    """The rows from the smallest start for which the selected row still fits, as far as the room goes."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(group)
    rows = df.withColumn("_end", F.sum(width).over(w)).withColumn("_begin", F.col("_end") - F.col(width))
    rows = rows.withColumn("_goal", F.max(F.when(F.col(selected), F.col("_end"))).over(all_))
    start = F.min(F.when(F.col("_goal") - F.col("_begin") <= room, F.col("_begin"))).over(all_)
    rows = rows.withColumn("_start", start)
    return rows.filter((F.col("_begin") >= F.col("_start")) & (F.col("_end") <= F.col("_start") + room)).drop("_end", "_begin", "_goal", "_start")


def palette(cells: DataFrame, colour: str = "fg", symbol: str = "symbol") -> DataFrame:
    """The distinct colours of cells that show something."""
    return cells.filter(F.trim(symbol) != "").select(colour).distinct()


def buffer_text(cells: DataFrame, frame: str, row: str, column: str, symbol: str) -> DataFrame:
    """(frame, row, line): the cells of each row as text without blanks at its end. A row is as wide as the screen."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(column, symbol))), lambda c: c[symbol]), "")
    return cells.groupBy(frame, row).agg(F.rtrim(line).alias("line"))


def page_window(selected: F.Column, room: int, total: F.Column) -> F.Column:
    """First row of a window of ``room`` rows that keeps ``selected`` visible, as late as needed."""
    return F.least(F.greatest(selected - room + 1, F.lit(0)), F.greatest(total - room, F.lit(0)))
