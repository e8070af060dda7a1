"""Long spans that stand verbatim in more than one record: recurring passages, confirmed and located by automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch
from .neardup import _M1, _M2, _mix

#: Letters of an automaton's alphabet: code points without surrogates.
ALPHABET = 1_000_000


def _gram(length: int) -> int:
    """Tokens of the runs that route a window: long enough to recur rarely by chance, short enough to be chosen from many."""
    return max(1, (3 * length) // 5)


def _run_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` tokens from each position on, by doubling; the last ``n - 1`` have no meaning."""

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate((x[by:], x[:by]))

    power = _mix(tokens + np.uint64(1), _M1)
    out, done, size = None, 0, 1
    while True:
        if n & size:
            part = ahead(power, done)
            out = part if out is None else _mix(out * _M2 + part, _M1)
            done += size
        if done == n:
            return out
        power = _mix(power * _M2 + ahead(power, size), _M1)
        size *= 2


def _least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each position on; the last ``n - 1`` have no meaning."""
    out, size = x, 1
    while size < n:
        step = min(size, n - size)
        out = np.minimum(out, np.concatenate((out[step:], out[:step])))
        size += step
    return out


def _flat(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, owner, place) of all sequences behind each other."""
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    tokens = np.concatenate(sequences).astype(np.int64).view(np.uint64) if len(sequences) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sequences)), sizes)
    return tokens, owner, np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _windows(sequences: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, route) of every window: its route is the least hash of the runs in it, so equal windows have equal routes."""
    tokens, owner, place = _flat(sequences)
    if len(tokens) < length:
        e = np.empty(0, np.int64)
        return e, e, e
    g = _gram(length)
    route = _least_of(_run_hashes(tokens, g), length - g + 1).view(np.int64)
    whole = np.flatnonzero(owner[: len(owner) - length + 1] == owner[length - 1 :])
    return owner[whole], place[whole], route[whole]


def _routes(length: int):
    """The distinct routes of each record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            owner, _, route = _windows(b["tokens"].tolist(), length)
            new = np.ones(len(owner), dtype=bool)
            order = np.lexsort((route, owner))
            owner, route = owner[order], route[order]
            new[1:] = (owner[1:] != owner[:-1]) | (route[1:] != route[:-1])
            yield pd.DataFrame({"cls": b["cls"].to_numpy()[owner[new]], "route": route[new]})

    return run


def _cut(length: int):
    """Stretches of consecutive windows of one route, for the routes that recur; a stretch is cut after ``length`` windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequences = [np.ascontiguousarray(t, dtype=np.int64) for t in b["tokens"]]
            owner, place, route = _windows(sequences, length)
            if not len(owner):
                continue
            first = np.ones(len(owner), dtype=bool)
            first[1:] = (owner[1:] != owner[:-1]) | (route[1:] != route[:-1])
            begins = np.flatnonzero(first)
            age = np.arange(len(owner)) - begins[np.cumsum(first) - 1]
            at = np.flatnonzero(age % length == 0)
            ends = np.append(at[1:], len(owner)) - 1
            wanted = [set(x.tolist()) for x in b["routes"]]
            keep = np.fromiter((r in wanted[o] for o, r in zip(owner[at].tolist(), route[at].tolist())), dtype=bool, count=len(at))
            at, ends = at[keep], ends[keep]
            seg = [sequences[o][s : e + length].tobytes() for o, s, e in zip(owner[at].tolist(), place[at].tolist(), place[ends].tolist())]
            yield pd.DataFrame({"cls": b["cls"].to_numpy()[owner[at]], "route": route[at], "start": place[at].astype(np.int32), "seg": seg})

    return run


def _window_rows(length: int):
    """Single windows of the stretches of crowded routes, each routed by its whole content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequences = [np.frombuffer(s, dtype=np.int64) for s in b["seg"]]
            tokens, owner, place = _flat(sequences)
            if len(tokens) < length:
                continue
            whole = np.flatnonzero(owner[: len(owner) - length + 1] == owner[length - 1 :])
            own, at = owner[whole], place[whole]
            seg = [sequences[o][s : s + length].tobytes() for o, s in zip(own.tolist(), at.tolist())]
            yield pd.DataFrame({"cls": b["cls"].to_numpy()[own], "route": _run_hashes(tokens, length).view(np.int64)[whole], "start": (b["start"].to_numpy()[own] + at).astype(np.int32), "seg": seg})

    return run


def _locate(length: int, shard_segments: int):
    """Over distinct stretches sorted by route: confirm the windows that recur, compile them, and stream the stretches through.

    A shard holds whole routes, so that all stretches that can hold a window are in its shard.
    """
    import ahocorasick

    def confirmed(tokens: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Positions of one window for each content that stands in more than one record: by hash counts, no window is cut out."""
        whole = np.flatnonzero(owner[: len(owner) - length + 1] == owner[length - 1 :])
        h = _run_hashes(tokens, length)[whole]
        order = np.argsort(h, kind="stable")
        h, at = h[order], whole[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        begins = np.flatnonzero(new)
        return at[begins[np.minimum.reduceat(low[owner[at]], begins) != np.maximum.reduceat(high[owner[at]], begins)]]

    def shard(rows: list[tuple[int, bytes, object, object]]) -> Iterator[tuple[bytes, int, int]]:
        sequences = [np.frombuffer(r[1], dtype=np.int64) for r in rows]
        tokens, owner, place = _flat(sequences)
        names, letters = np.unique(tokens, return_inverse=True)
        if len(names) > ALPHABET and rows[0][0] != rows[-1][0]:
            half = next(i for i in range(1, len(rows)) if rows[i][0] != rows[i - 1][0] and i >= len(rows) // 2 or rows[i][0] == rows[-1][0])
            yield from shard(rows[:half])
            yield from shard(rows[half:])
            return
        ids = {x: i for i, x in enumerate(sorted({y for r in rows for y in r[2:]}))}
        low, high = (np.array([ids[r[k]] for r in rows]) for k in (2, 3))
        passages = confirmed(tokens, owner, low, high)
        if not len(passages):
            return
        letters = letters.astype(np.uint32) + np.uint32(0x100)
        letters += np.where(letters >= 0xD800, np.uint32(0x800), np.uint32(0))
        text = letters.astype("<u4").tobytes().decode("utf-32-le")
        phrases = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in passages.tolist():
            phrases.add_word(text[p : p + length])
        phrases.make_automaton()
        begin = 0
        for seq, (_, seg, _, _) in zip(sequences, rows):
            last = np.fromiter((e for e, _ in phrases.iter(text, begin, begin + len(seq))), dtype=np.int64) - begin + 1
            begin += len(seq)
            if len(last):
                gaps = np.flatnonzero(np.diff(last) > length)
                for a, b in zip(last[np.append(0, gaps + 1)].tolist(), last[np.append(gaps, len(last) - 1)].tolist()):
                    yield seg, a - length, b

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes, object, object]] = []

        def flush() -> pd.DataFrame:
            found = list(shard(held))
            held.clear()
            return pd.DataFrame({"seg": [x[0] for x in found], "a": [x[1] for x in found], "b": [x[2] for x in found]})

        for b in batches:
            for row in zip(b["route"].tolist(), b["seg"].tolist(), b["low"].tolist(), b["high"].tolist()):
                if len(held) >= shard_segments and row[0] != held[-1][0]:
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return run


def shared_spans(df: DataFrame, row_id: str, sequence: str, length: int = 40, shard_segments: int = 4000, crowd: int = 12_000) -> DataFrame:
    """(id, span_start, span_end): the maximal stretches of positions that lie in a run of at least ``length`` tokens that
    also stands in another record. Starts count from 0, ends are exclusive.

    Every window of ``length`` tokens is routed by the least hash of the shorter runs in it, so all occurrences of a window have one
    route. First the routes are counted: one that stands in a single record is done with, and only its number was shuffled.
    Then the records that hold recurring routes are cut into stretches of consecutive windows of one such route, each sent to the
    shard of its route; so all records are streamed through the automata, each part through the one that can match it. Equal
    stretches are merged before that shuffle, with the least and greatest record that hold them. A shard of whole routes confirms the
    windows that recur in two records by counting their hashes, compiles them into an Aho-Corasick automaton and locates every
    occurrence, token by token; shards hold about ``shard_segments`` stretches. A route with more than ``crowd`` different stretches is cut
    into single windows, each routed by its whole content; then equal windows are one row and no shard grows. Found stretches go
    back to the records and are merged across borders.

    Equal sequences are handled once, and wholly shared if they are long enough. Tokens are compared by 64-bit hashes. Null sequences and those shorter
    than ``length`` have no span; a null token is a token of its own; a repeated id counts once; null ids are left out; an
    empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    crowd = min(crowd, max(1, ALPHABET // (2 * length)))
    rows = df.filter(F.col(row_id).isNotNull() & (F.size(sequence) >= length)).select(F.col(row_id).alias("id"), F.col(sequence).alias("s")).dropDuplicates(["id"])
    rows = rows.select("id", F.transform("s", lambda t: F.xxhash64(F.coalesce(t.cast("string"), F.lit("\0")))).alias("tokens"))
    rows = scratch.save(rows.select("*", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(7), "tokens", F.size("tokens")).alias("h2")))
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("cls"), F.count("*").alias("copies"))
    members = scratch.save(rows.select("id", "h1", "h2", F.size("tokens").alias("n")).join(classes, ["h1", "h2"]).select("id", "cls", "copies", "n"))
    alone = rows.join(members.filter("id = cls").select("id"), "id", "left_semi").select(F.col("id").alias("cls"), "tokens")
    kind = rows.schema["id"].dataType.simpleString()

    routed = scratch.save(alone.mapInPandas(_routes(length), f"cls {kind}, route bigint"))
    recurring = routed.groupBy("route").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b").select("route")
    # at most as many as the record has windows
    own = routed.join(recurring, "route", "left_semi").groupBy("cls").agg(F.collect_list("route").alias("routes"))
    schema = f"cls {kind}, route bigint, start int, seg binary"
    segments = scratch.save(alone.join(own, "cls").mapInPandas(_cut(length), schema))
    # a class of several records shares all of itself: it is not looked up, but others may share with it
    distinct = scratch.save(segments.groupBy("route", "seg").agg(F.min("cls").alias("low"), F.max("cls").alias("high")))
    crowded = scratch.save(distinct.groupBy("route").count().filter(F.col("count") > crowd).select("route"))
    if not crowded.isEmpty():
        again = segments.join(crowded, "route", "left_semi").mapInPandas(_window_rows(length), schema)
        segments = scratch.save(segments.join(crowded, "route", "left_anti").unionByName(again))
        distinct = scratch.save(segments.groupBy("route", "seg").agg(F.min("cls").alias("low"), F.max("cls").alias("high")))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    located = distinct.repartition(parts, "route").sortWithinPartitions("route").mapInPandas(_locate(length, shard_segments), "seg binary, a int, b int")
    located = located.groupBy("seg").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    single = members.filter("copies = 1").select("cls")
    spans = segments.join(located, "seg").select("cls", "start", F.explode("found").alias("f")).select("cls", (F.col("start") + F.col("f.a")).alias("a"), (F.col("start") + F.col("f.b")).alias("b"))
    spans = spans.join(single, "cls", "left_semi")
    # stretches that overlap or touch are one: they are all stretches of one record, at most as many as it has windows
    before = Window.partitionBy("cls").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("cls").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    merged = spans.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(before), F.lit(True)).cast("int")).withColumn("g", F.sum("new").over(upto))
    merged = merged.groupBy(F.col("cls").alias("id"), "g").agg(F.min("a").cast("bigint").alias("span_start"), F.max("b").cast("bigint").alias("span_end")).drop("g")
    whole = members.filter("copies > 1").select("id", F.lit(0).cast("bigint").alias("span_start"), F.col("n").cast("bigint").alias("span_end"))
    return merged.unionByName(whole)
