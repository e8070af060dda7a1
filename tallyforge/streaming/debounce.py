"""Anchored debouncing and easing: sequential per key, with constant state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce(df: DataFrame, key: str, at_ms: str, window_ms: int = 300) -> DataFrame:
    """(key, anchor, fires_at, events): the first event opens a window of fixed length that later ones do not extend.

    Rows are sorted within their partition and streamed through with one open window per key, so a key of any
    length takes constant memory. (``session_window`` would extend the window with each event.) Null keys and times are left out.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor, n = None, 0, 0
        for b in batches:
            rows = []
            for k, t in zip(b["k"].tolist(), b["t"].tolist()):
                if n and k == now and t < anchor + window_ms:
                    n += 1
                    continue
                if n:
                    rows.append((now, anchor, anchor + window_ms, n))
                now, anchor, n = k, t, 1
            yield pd.DataFrame(rows, columns=["key", "anchor", "fires_at", "events"])
        if n:
            yield pd.DataFrame([(now, anchor, anchor + window_ms, n)], columns=["key", "anchor", "fires_at", "events"])

    rows = df.select(F.col(key).alias("k"), F.col(at_ms).cast("bigint").alias("t")).dropna()
    out = rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(run, f"key {kind}, anchor bigint, fires_at bigint, events bigint")
    return out.withColumnRenamed("key", key)


def ease(df: DataFrame, key: str, at: str, target: str, rate: float = 8.0, snap: float = 0.001) -> DataFrame:
    """``df``'s (key, at, target) with ``eased``: v += (target - v)(1 - exp(-rate dt)), snapping to the target when near; starts at 0.

    ``at`` is in seconds. Streams sorted rows with one value per key.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, v = None, 0.0, 0.0
        for b in batches:
            out = []
            for k, t, goal in zip(b["k"].tolist(), b["t"].tolist(), b["goal"].tolist()):
                if k != now:
                    now, last, v = k, t, 0.0
                v += (goal - v) * (1.0 - math.exp(-rate * (t - last)))
                if abs(goal - v) < snap:
                    v = goal
                last = t
                out.append(v)
            yield b.assign(eased=out)

    rows = df.select(F.col(key).alias("k"), F.col(at).cast("double").alias("t"), F.col(target).cast("double").alias("goal")).dropna()
    out = rows.repartition("k").sortWithinPartitions("k", "t", "goal").mapInPandas(run, f"k {kind}, t double, goal double, eased double")
    return out.select(F.col("k").alias(key), F.col("t").alias(at), F.col("goal").alias(target), "eased")


def debounce_stream(df: DataFrame, key: str, ts: str, window_ms: int = 300, lateness: str = "1 second") -> DataFrame:
    """The same on a stream: one open window per key in the state store, closed by a later event or by the watermark."""
    kind = dict(df.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        anchor, n = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            rows.append((k[0], anchor, anchor + window_ms, n))
            state.remove()
        else:
            times = sorted(t for b in batches for t in b["t"].tolist())
            for t in times:
                if n and t < anchor + window_ms:
                    n += 1
                    continue
                if n:
                    rows.append((k[0], anchor, anchor + window_ms, n))
                anchor, n = t, 1
            state.update((anchor, n))
            state.setTimeoutTimestamp(max(anchor + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "anchor", "fires_at", "events"])

    rows = df.withWatermark(ts, lateness).select(F.col(key).alias("k"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("t"))
    out = rows.groupBy("k").applyInPandasWithState(run, f"key {kind}, anchor long, fires_at long, events long", "anchor long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", key)
