"""Mixing sources to target shares, sized in tokens of a public tokenizer, with capped repetition."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: A fixed value: the public word-splitting pattern of the 50k byte-level vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The plan is made on the driver over one row per source of the target table.
MAX_SOURCES = 100_000


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(vocabulary: str | dict[bytes, int]):
    import tiktoken

    ranks = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def clean_source(c) -> F.Column:
    """Letter case and surrounding blanks of a source carry no meaning."""
    return F.lower(F.trim(c))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): each document once, whole texts; null and empty texts have 0 tokens.

    Texts are counted where they are read, and only the counts are shuffled. Special strings are ordinary text. The vocabulary is
    read by the driver and sent along (about 1 MB for 50,000 tokens), so executors need no such file.
    """
    kind = dict(docs.dtypes)[doc_id]
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(ranks.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(encode(t)) if t else 0 for t in b["text"]]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), clean_source(F.col(source)).alias("source"), F.col(text).alias("text"))
    return rows.mapInPandas(count, f"doc_id {kind}, source string, tokens bigint").dropDuplicates(["doc_id"])


def fill_shares(sizes: dict[str, float], shares: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens to draw from each source: capped water-filling.

    Every source starts at its target share of ``total``. A source that would need more than ``caps`` repetitions is
    clamped there, and what it lacks goes to the others in proportion to their targets, until nothing changes. If all are
    clamped the total is out of reach and each gives what it has.
    """
    limit = {s: caps[s] * sizes.get(s, 0.0) for s in shares}
    fixed: dict[str, float] = {}
    while True:
        free = {s: w for s, w in shares.items() if s not in fixed and w > 0}
        weight = math.fsum(free.values())
        left = total - math.fsum(fixed.values())
        over = {s: limit[s] for s, w in free.items() if weight > 0 and left * w / weight > limit[s]}
        if not over:
            return {s: fixed.get(s, left * w / weight if w > 0 and weight > 0 else 0.0) for s, w in shares.items()}
        fixed |= over


def mixing_plan(counts: DataFrame, targets: DataFrame, total: float | None = None, max_sources: int = MAX_SOURCES) -> DataFrame:
    """One row per target row: size, target_tokens, drawn_tokens, repeats, reached_share, falls_short.

    ``total`` is the size of the mix in tokens, by default the size of all documents whose source is listed. A source
    falls short if the filling clamped it, at ``max_repeats`` times its size, below its target share of the total. Target rows that repeat a source
    count once; rows with a null source, share or cap are treated as share 0 or cap 0. A source without documents has size 0;
    documents of unlisted or null sources take no part. ``targets`` has one row per source, so it is bounded by
    ``max_sources`` (checked); documents are only ever summed in the cluster.
    """
    t = targets.select("source", clean_source(F.col("source")).alias("k"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(0.0)).alias("cap")).filter("source is not null").dropDuplicates(["k"])
    wanted = t.limit(max_sources + 1).collect()
    if len(wanted) > max_sources:
        raise ValueError(f"more than {max_sources} sources in the target table")
    names = [r["k"] for r in wanted]
    sized = counts.filter(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens").alias("size")).collect()
    sizes = {n: 0.0 for n in names} | {r["source"]: float(r["size"]) for r in sized}
    whole = math.fsum(sizes.values()) if total is None else float(total)
    shares, caps = {r["k"]: r["w"] for r in wanted}, {r["k"]: r["cap"] for r in wanted}
    drawn = fill_shares(sizes, shares, caps, whole)
    got = math.fsum(drawn.values())
    rows = [
        (r["source"], int(sizes[k]), float(shares[k]), float(caps[k]), whole * shares[k], drawn[k], drawn[k] / sizes[k] if sizes[k] else 0.0, drawn[k] / got if got else 0.0, drawn[k] == caps[k] * sizes[k] and drawn[k] < whole * shares[k])
        for r in wanted
        for k in [r["k"]]
    ]
    schema = "source string, size bigint, target_share double, max_repeats double, target_tokens double, drawn_tokens double, repeats double, reached_share double, falls_short boolean"
    return counts.sparkSession.createDataFrame(rows, schema)


def draw(counts: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, copies): whole repetitions for every document, and one more for a seeded fraction of them.

    The choice depends on the seed and the id only, so it is the same in every run and however the data are split.
    Sampling is the feature here: documents drawn 0 times are not returned.
    """
    p = plan.select(clean_source(F.col("source")).alias("source"), F.floor("repeats").alias("whole"), (F.col("repeats") - F.floor("repeats")).alias("part"))
    # 53 bits of the hash make a uniform number in [0, 1)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    drawn = counts.join(F.broadcast(p), "source").withColumn("copies", F.col("whole") + F.when(u < F.col("part"), 1).otherwise(0))
    return drawn.filter("copies > 0").select("doc_id", "source", "tokens", F.col("copies").cast("bigint").alias("copies"))
