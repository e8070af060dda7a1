"""A mergeable quantile sketch: exact up to 256 values per group, then centroids of equal weight."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Fixed value: centroids after compression. A sketch is compressed when it holds more than twice as many.
CENTROIDS = 128
#: Centroids that a task holds over all groups before it hands its sketches on; they merge later.
HELD = 1_000_000


def compress(means: np.ndarray, weights: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` centroids of equal weight, cut out of the sorted ones; a centroid at a border is split."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    if len(means) <= 2 * k:
        return means, weights
    upto = np.concatenate(([0.0], np.cumsum(weights)))
    moment = np.concatenate(([0.0], np.cumsum(weights * means)))
    borders = np.linspace(0.0, upto[-1], k + 1)
    at = np.clip(np.searchsorted(upto, borders, side="right") - 1, 0, len(means) - 1)
    mass = moment[at] + (borders - upto[at]) * means[at]
    w = np.diff(borders)
    return np.clip(np.diff(mass) / w, means[0], means[-1]), w


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, p: float) -> float:
    """Interpolated like exact order statistics while all weights are 1, else between the centres of the centroids."""
    if np.all(weights == 1.0):
        return float(np.quantile(means, p))
    centre = np.cumsum(weights) - weights / 2
    total = weights.sum()
    return float(np.interp(p * total, np.concatenate(([0.0], centre, [total])), np.concatenate(([low], means, [high]))))


def sketches(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, means, weights, low, high): partial sketches of the finite values, one or more per task and group.

    They merge in any order, so those of several days can be kept and combined with ``merged``.
    """
    keys = list(group)
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "means array<double>", "weights array<double>", "low double", "high double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, list] = {}
        held = 0

        def flush() -> pd.DataFrame:
            rows = [(*k, *compress(m, w), lo, hi) for k, (m, w, lo, hi) in state.items()]
            state.clear()
            return pd.DataFrame(rows, columns=[*keys, "means", "weights", "low", "high"])

        for b in batches:
            for k, v in b.groupby(keys, dropna=False, sort=False)["_v"] if keys else [((), b["_v"])]:
                x = v.to_numpy(dtype=float)
                k = tuple(None if pd.isna(i) else i for i in (k if isinstance(k, tuple) else (k,)))
                m, w, lo, hi = state.get(k, (np.empty(0), np.empty(0), np.inf, -np.inf))
                held -= len(m)
                m, w = compress(np.concatenate((m, x)), np.concatenate((w, np.ones(len(x)))))
                state[k] = (m, w, min(lo, x.min()), max(hi, x.max()))
                held += len(m)
            if held > HELD:
                yield flush()
                held = 0
        if state:
            yield flush()

    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, v.alias("_v"))
    return rows.mapInPandas(run, schema)


def _merge(keys: list[str]):
    """Merge consecutive rows of equal keys; holds one sketch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, m, w, lo, hi = None, np.empty(0), np.empty(0), np.inf, -np.inf
        for b in batches:
            rows = []
            held = [b[k].tolist() for k in keys]
            for row in zip(*held, b["means"], b["weights"], b["low"].tolist(), b["high"].tolist()):
                k = tuple(None if pd.isna(x) else x for x in row[: len(keys)])
                if k != now and len(m):
                    rows.append((*now, *compress(m, w), lo, hi))
                    m, w, lo, hi = np.empty(0), np.empty(0), np.inf, -np.inf
                now = k
                m, w = compress(np.concatenate((m, row[-4])), np.concatenate((w, row[-3])))
                lo, hi = min(lo, row[-2]), max(hi, row[-1])
            yield pd.DataFrame(rows, columns=[*keys, "means", "weights", "low", "high"])
        if len(m):
            yield pd.DataFrame([(*now, m, w, lo, hi)], columns=[*keys, "means", "weights", "low", "high"])

    return run


def merged(parts: DataFrame, group: Sequence[str], fan: int = 32) -> DataFrame:
    """One sketch per group, merged in two levels so that a group of any number of partial sketches spreads over ``fan`` tasks first.

    Each task streams its sorted rows and holds one sketch at a time."""
    keys = list(group)
    kinds = dict(parts.dtypes)
    tail = "means array<double>, weights array<double>, low double, high double"
    head = [f"`{k}` {kinds[k]}" for k in keys]
    first = parts.withColumn("_s", F.pmod(F.xxhash64("low", "high", "means"), F.lit(fan)))
    first = first.repartition(*keys, "_s").sortWithinPartitions(*keys, "_s").mapInPandas(_merge([*keys, "_s"]), ", ".join([*head, "`_s` bigint", tail])).drop("_s")
    spread = first.repartition(*keys).sortWithinPartitions(*keys) if keys else first.coalesce(1)
    return spread.mapInPandas(_merge(keys), ", ".join([*head, tail]))


def quantiles(sketch: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(group, n, q0, q1, ...) of ``merged`` sketches."""
    keys = list(group)
    schema = ", ".join([*[f"`{k}` {dict(sketch.dtypes)[k]}" for k in keys], "n bigint", *[f"q{i} double" for i in range(len(probs))]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            pairs = [(np.asarray(m, dtype=float), np.asarray(w, dtype=float)) for m, w in zip(b["means"], b["weights"])]
            out["n"] = [int(round(w.sum())) for _, w in pairs]
            for i, p in enumerate(probs):
                out[f"q{i}"] = [quantile(m, w, lo, hi, p) for (m, w), lo, hi in zip(pairs, b["low"], b["high"])]
            yield out

    return sketch.mapInPandas(run, schema)
