"""Evaluation passages inside training documents: BM25 over the items, block by block, then exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch

WORD = re.compile("[a-z0-9]+")
K1, B = 1.2, 0.75


@dataclass
class ItemIndex:
    """Inverted lists of one shard of items, as they are sent to the executors: plain arrays, a few bytes for each word of an item.

    Items are numbered by rising threshold, so items of one block have alike thresholds.
    """

    ids: list
    words: dict[str, int]
    start: np.ndarray  # per word: where its list starts; lists are sorted by item
    item: np.ndarray
    impact: np.ndarray  # BM25 weight of the word in the item
    block_start: np.ndarray  # per word: where its list of blocks starts
    block: np.ndarray
    block_max: np.ndarray  # the greatest impact of the word in the block
    floor: np.ndarray  # per item: the least score of any passage that holds one of its runs
    block_floor: np.ndarray
    width: int  # items of a block
    run_start: np.ndarray  # per item: where its runs start
    run: np.ndarray  # hashes of its runs of n words, sorted inside each item
    n: int


_M = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` word numbers."""
    m = len(code) - n + 1
    h = np.zeros(max(m, 0), dtype=np.uint64)
    for i in range(n if m > 0 else 0):
        h = (h ^ (code[i : m + i].astype(np.uint64) + np.uint64(1))) * _M
        h ^= h >> np.uint64(29)
    return h


def build_index(items: list[tuple[object, str | None]], n: int, block: int = 16) -> ItemIndex | None:
    """Index items that have at least ``n`` words; None if there is none."""
    texts = [(i, WORD.findall(t.lower())) for i, t in items if i is not None and t]
    texts = [(i, w) for i, w in texts if len(w) >= n]
    if not texts:
        return None
    words: dict[str, int] = {}
    coded = [np.array([words.setdefault(x, len(words)) for x in w], dtype=np.int32) for _, w in texts]
    lengths = np.array([len(c) for c in coded], dtype=np.float64)
    own = [np.unique(c, return_counts=True) for c in coded]
    word = np.concatenate([w for w, _ in own])
    item = np.repeat(np.arange(len(coded)), [len(w) for w, _ in own])
    tf = np.concatenate([c for _, c in own]).astype(np.float64)
    df = np.bincount(word, minlength=len(words))
    idf = np.log1p((len(coded) - df + 0.5) / (df + 0.5))
    impact = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / lengths.mean()))
    floor = np.empty(len(coded))
    at = np.concatenate(([0], np.cumsum([len(w) for w, _ in own])))
    for j, c in enumerate(coded):
        weight = impact[at[j] : at[j + 1]][np.searchsorted(own[j][0], c)]
        s = np.sort(np.lib.stride_tricks.sliding_window_view(c, n), axis=1)
        order = np.argsort(np.lib.stride_tricks.sliding_window_view(c, n), axis=1, kind="stable")
        first = np.ones(s.shape, dtype=bool)
        first[:, 1:] = s[:, 1:] != s[:, :-1]
        held = np.take_along_axis(np.lib.stride_tricks.sliding_window_view(weight, n), order, axis=1)
        floor[j] = (held * first).sum(axis=1).min()
    rank = np.argsort(floor, kind="stable")
    place = np.empty_like(rank)
    place[rank] = np.arange(len(rank))
    item = place[item]
    order = np.lexsort((item, word))
    word, item, impact = word[order], item[order], impact[order].astype(np.float32)
    key = word.astype(np.int64) * len(coded) + item // block
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    runs = [np.unique(run_hashes(coded[j], n)) for j in rank]
    floor = (floor[rank] * (1 - 1e-4)).astype(np.float32)  # room for single precision
    lists = np.arange(len(words) + 1)
    return ItemIndex(
        ids=[texts[j][0] for j in rank],
        words=words,
        start=np.searchsorted(word, lists),
        item=item.astype(np.int32),
        impact=impact,
        block_start=np.searchsorted(word[first], lists),
        block=(item[first] // block).astype(np.int32),
        block_max=np.maximum.reduceat(impact, first),
        floor=floor,
        block_floor=np.minimum.reduceat(floor, np.arange(0, len(floor), block)),
        width=block,
        run_start=np.concatenate(([0], np.cumsum([len(r) for r in runs]))),
        run=np.concatenate(runs),
        n=n,
    )


def passages(text: str, words: dict[str, int], n: int, width: int) -> list[np.ndarray]:
    """The runs of at least ``n`` words that all occur in items, cut to ``width`` words with ``n - 1`` of overlap.

    A run shared with an item lies wholly inside one of them, so nothing is lost.
    """
    get = words.get
    code = np.fromiter((get(w, -1) for w in WORD.findall(text.lower())), dtype=np.int32)
    if len(code) < n:
        return []
    gaps = np.flatnonzero(code < 0)
    edges = np.concatenate(([-1], gaps, [len(code)]))
    out = []
    for k in np.flatnonzero(np.diff(edges) > n):
        a, b = edges[k] + 1, edges[k + 1]
        while True:
            out.append(code[a : min(b, a + width)])
            if a + width >= b:
                break
            a += width - n + 1
    return out


def _lists(start: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which query word, which posting) of all entries in the lists of the words."""
    size = start[word + 1] - start[word]
    owner = np.repeat(np.arange(len(word)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[word], size)


def matches(batch: list[tuple[object, np.ndarray]], index: ItemIndex) -> Iterator[tuple[object, object]]:
    """(document, item) pairs of the passages, in the order block maxima allow.

    The lists of a passage's words are first walked by block: the sum of the block maxima bounds every score inside the block, and a
    block whose bound stays below its least threshold is skipped, postings and all. Only in the blocks that remain postings are read and
    items scored; those above their own threshold are verified by the runs themselves. Passages take each step together.
    """
    blocks = len(index.block_floor)
    own = [np.unique(p) for _, p in batch]
    word = np.concatenate(own)
    query = np.repeat(np.arange(len(own)), [len(w) for w in own])
    owner, at = _lists(index.block_start, word)
    key = query[owner] * np.int64(blocks) + index.block[at]
    bound = np.bincount(key, weights=index.block_max[at], minlength=len(batch) * blocks).reshape(len(batch), blocks)
    open_ = bound >= index.block_floor
    owner, at = _lists(index.start, word[open_[query].any(axis=1)])
    query = query[open_[query].any(axis=1)]
    q, j = query[owner], index.item[at]
    left = open_[q, j // index.width]
    q, j = q[left], j[left]
    pair, back = np.unique(q * np.int64(len(index.ids)) + j, return_inverse=True)
    score = np.bincount(back, weights=index.impact[at[left]], minlength=len(pair))
    q, j = pair // len(index.ids), pair % len(index.ids)
    hit = score >= index.floor[j]
    q, j = q[hit], j[hit]
    for r, first in zip(*np.unique(q, return_index=True)):
        doc, p = batch[r]
        held = run_hashes(p, index.n)
        for i in j[first : first + np.searchsorted(q[first:], r, side="right")].tolist():
            runs = index.run[index.run_start[i] : index.run_start[i + 1]]
            near = np.searchsorted(runs, held)
            if (runs[np.minimum(near, len(runs) - 1)] == held).any():
                yield doc, index.ids[i]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 12, shard_rows: int = 100_000, shard_chars: int = 20_000_000, width: int = 64) -> DataFrame:
    """(doc_id, item_id) for every document that shares at least ``n`` consecutive words with an item.

    A word is a longest run of a-z and 0-9 after lower-casing. Every passage of every document queries a BM25 index of
    the items, inverted lists in blocks with their maxima. The score that a passage must reach is the least score that any run of ``n`` words
    of the item gives, so retrieval loses no true case; block maxima rule out whole blocks of items before any of their postings is read;
    what reaches the threshold is verified by its runs. Documents are not shuffled.

    The index grows with the words of the items, by at most 40 bytes for each. One index holds about ``shard_rows`` items and
    ``shard_chars`` characters at most (checked before they are fetched; some 150 MB). Beyond that the items are split by a hash of their id into
    as many shards as the bounds need; shards are taken one after the other, the documents are read once for each, and a shard's broadcast is
    destroyed before the next is made. So one scan is the rule, and memory is bounded in any case.

    Null and empty texts, items shorter than ``n`` words and null ids match nothing; repeated rows and repeated items count once;
    empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    rows = docs.filter(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    own = items.filter(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()

    def scan(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(**shared.value)
            # so many passages at a time that their bounds take 16 MB
            size = max(16, (2 << 20) // len(index.block_floor))
            for b in batches:
                queue, found = [], set()
                for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
                    queue += [(d, p) for p in passages(t, index.words, index.n, width)]
                    if len(queue) >= min(size, 512):
                        found.update(matches(queue, index))
                        queue = []
                if queue:
                    found.update(matches(queue, index))
                yield pd.DataFrame(list(found), columns=["doc_id", "item_id"])

        return run

    count, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    shards = max(1, -(-count // shard_rows), -(-chars // shard_chars))
    out = None
    scratch = Scratch(spark)
    for k in range(shards):
        part = own.filter(F.pmod(F.xxhash64("i"), F.lit(shards)) == k).collect()  # bounded by the two limits
        index = build_index([(r["i"], r["t"]) for r in part], n)
        if not index:
            continue
        shared = spark.sparkContext.broadcast(vars(index))
        found = rows.mapInPandas(scan(shared), schema)
        if shards > 1:
            found = scratch.save(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return (out if out is not None else spark.createDataFrame([], schema)).dropDuplicates()
