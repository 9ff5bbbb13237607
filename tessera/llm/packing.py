"""Packing documents into training windows by multiway differencing (Karmarkar and Karp).

Documents are counted in tokens and cut into pieces of at most CAPACITY; pieces that
fill a window are windows. The others are dealt by hash into shards of about
SHARD_WINDOWS windows, whose number grows with the corpus. Within a shard every
piece starts as a partial partition, one sum and k - 1 zeros; the two partitions
with the largest spread are merged, the largest sum of one with the smallest of the
other, until one is left: k windows of nearly equal size. k starts at the least
number that could hold the shard and rises whenever a window exceeds the capacity.

Only ids and lengths are shuffled, never texts.

A piece's shard follows from its id and the place of its row in the counted table, so that rows without an id, or
thousands with the same one, spread over all shards.

Defined results: documents without tokens (null or empty text) are pieces of length
0; null doc_ids and repeated rows are packed like any other row; of equal pieces the
smaller doc_id, then piece, goes first; an empty table gives no windows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .tokens import VOCABULARY, counted

CAPACITY = 8192
SHARD_WINDOWS = 64
#: Pieces of a shard, about, where they are too short to fill its windows.
SHARD_PIECES = 1 << 17


def difference(lengths: list[int], k: int) -> list[tuple[int, list[int]]]:
    """k windows as (sum, indices into lengths)."""
    if k == 1 or not lengths:
        return [(sum(lengths), list(range(len(lengths))))] + [(0, [])] * (k - 1)
    # a partial partition: its sums in descending order, less the smallest, each with a tree of members; zeros at the end are left out
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    serial = len(lengths)
    none = (0, None)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            merged = a + b
        else:
            a += [none] * (k - len(a))
            b += [none] * (k - len(b))
            merged = [(x + y, q if p is None else p if q is None else (p, q)) for (x, p), (y, q) in zip(a, reversed(b))]
        merged.sort(key=lambda s: -s[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    out = []
    for total, tree in heap[0][2]:
        members, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            elif t is not None:
                members.append(t)
        out.append((total, sorted(members)))
    return out + [(0, [])] * (k - len(out))


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces of each window; none exceeds the capacity."""
    k = max(1, math.ceil(sum(lengths) / capacity))
    while True:
        found = difference(lengths, k)
        if max(total for total, _ in found) <= capacity or k >= len(lengths):
            return [members for _, members in found if members]
        k += 1


def packed(pieces: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Windows of pieces (doc_id, piece, n_tokens, row), shard by shard; row is any number that repeated rows don't share."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], na_position="first").reset_index(drop=True)
        full = int((pdf.n_tokens == capacity).sum())
        window = [0] * len(pdf)
        for i in range(full):
            window[i] = i
        for j, members in enumerate(windows(pdf.n_tokens[full:].tolist(), capacity) if full < len(pdf) else []):
            for m in members:
                window[full + m] = full + j
        pdf["window"] = window
        pdf["window_tokens"] = pdf.groupby("window").n_tokens.transform("sum")
        return pdf[["shard", "window", "doc_id", "piece", "n_tokens", "window_tokens"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(pack, "shard int, window int, doc_id long, piece int, n_tokens long, window_tokens long")


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """(shard, window, doc_id, piece, n_tokens, window_tokens): a row for each piece of each document."""
    T.shared_folder(spark)
    lengths = counted(docs, path).checkpoint()  # counted once, then read for the total and for the windows
    lengths = lengths.withColumn("row", F.monotonically_increasing_id())  # the same each time, since the table is written
    total, n = lengths.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    shards = max(1, math.ceil(total / (capacity * SHARD_WINDOWS)), math.ceil(n / SHARD_PIECES))
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int") - 1
    pieces = lengths.select("doc_id", "row", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", F.least(F.col("n_tokens") - F.col("piece").cast("long") * capacity, F.lit(capacity)).alias("n_tokens"))
    return packed(pieces, capacity, shards)
