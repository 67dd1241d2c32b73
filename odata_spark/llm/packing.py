"""Packing into optimal length buckets under a token budget.

The global histogram of lengths goes to the driver in cells (exact up to EXACT tokens, then
STEPS cells to each doubling, so a few thousand rows at any corpus size), each with the largest
length that occurs in it; dynamic programming chooses at most `buckets` boundaries among these
lengths that minimise padding. A boundary is thus always the length of its longest document.
Inside each bucket, documents are numbered in two levels (shards of bounded size, then offsets
of the shards), so that no task holds a whole bucket, and batches take `budget // bucket_len`
documents each, one at least.

Defined results: null or empty texts have the one end token. A document longer than the
budget is a batch of its own, whole. Repeated rows each take a place. An empty table gives an
empty table. Only doc_id and text are read, and only doc_id and the computed columns returned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

EXACT, STEPS = 2048, 256
ADDED = ("n_tokens", "bucket", "bucket_len", "batch", "slot", "padding")


def length_in_words(name: str = "text") -> Column:
    """Words and one end token, without building the words."""
    return (F.regexp_count(text_or_empty(name), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def ceil_on_grid(n: Column) -> Column:
    """The cell of a length."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) - int(math.log2(STEPS)))
    return F.when(n <= EXACT, n).otherwise((F.ceil(n / step) * step).cast("long")).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least total padding (exact dynamic programming).

    Cost of lengths i..j in one bucket is counts[i..j].sum() * lengths[j], less a constant;
    the best split point never moves left as j grows, so each layer is solved by halving.
    """
    u = len(lengths)
    if not u:
        return []
    total = np.concatenate([[0.0], np.cumsum(counts, dtype=float)])
    best = total[1:] * lengths
    cuts = []
    for _ in range(min(buckets, u) - 1):
        new, at = best.copy(), np.full(u, -1)
        stack = [(0, u - 1, 0, u - 1)]
        while stack:
            lo, hi, left, right = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(j - 1, right) + 1)
            k = left
            if len(i):
                cost = best[i] + (total[j + 1] - total[i + 1]) * lengths[j]
                k = int(i[np.argmin(cost)])
                if cost[k - left] < new[j]:
                    new[j], at[j] = cost[k - left], k
            stack += [(lo, j - 1, left, k), (j + 1, hi, k, right)]
        best = new
        cuts.append(at)
    ends, j = [], u - 1
    for at in reversed(cuts):
        ends.append(int(lengths[j]))
        j = at[j]
        if j < 0:
            return sorted(ends)
    return sorted([*ends, int(lengths[j])])


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, budget: int = 65536, shard: int = 20_000) -> DataFrame:
    """doc_id and ADDED, one row per row of docs. `length` defaults to words and an end token."""
    # Rows without an id, or of one id, are dealt by their text.
    sized = docs.select("doc_id", (length_in_words() if length is None else length).alias("n_tokens"), F.xxhash64("doc_id", "text").alias("__key"))
    sized = materialize(sized, "lengths")
    hist = sized.groupBy(ceil_on_grid(F.col("n_tokens")).alias("cell")).agg(F.count("*").alias("count"), F.max("n_tokens").alias("longest")).orderBy("cell").collect()
    rows = sum(r["count"] for r in hist)
    ends = optimal_boundaries(np.array([r["longest"] for r in hist]), np.array([r["count"] for r in hist]), buckets)
    bucket, size = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in reversed(range(len(ends))):
        bucket = F.when(F.col("n_tokens") <= ends[k], k).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= ends[k], F.lit(ends[k]).cast("long")).otherwise(size)
    shards = max(1, -(-rows // shard))
    sized = sized.withColumns({"bucket": bucket, "bucket_len": size, "__shard": F.pmod("__key", F.lit(shards))})
    per = sized.groupBy("bucket", "__shard").count()  # rows / shard size x buckets rows at most
    offsets = per.select("bucket", "__shard", (F.sum("count").over(Window.partitionBy("bucket").orderBy("__shard")) - F.col("count")).alias("__before"))
    numbered = sized.withColumn("__rn", F.row_number().over(Window.partitionBy("bucket", "__shard").orderBy("doc_id", "n_tokens", "__key")))
    place = F.col("__before") + F.col("__rn") - 1
    cap = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return numbered.join(offsets, ["bucket", "__shard"]).select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor(place / cap).cast("long").alias("batch"),
        (place % cap).cast("long").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
