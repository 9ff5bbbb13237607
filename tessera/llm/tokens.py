"""Token counts by an exact length histogram, and the token counting itself.

Counting: a byte-level BPE first cuts a text into pieces by a pattern over letters,
numbers, other characters and white space. The cutting is done here for a whole
slice at once; a piece is encoded when it is first met, and its count is kept, so
that the encoder sees each distinct piece once. The new pieces of a slice are encoded
in one call. The counts equal the encoder's own.

Histogram: documents are aggregated by encoded length; suffix sums then answer
totals, quantiles and truncated totals for every context limit without a look at
the documents.

Defined results: null and empty texts have 0 tokens; rows without a doc_id count in
the histogram like all others; an empty table gives an empty histogram; repeated rows
count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T

#: Where public tokenizers' vocabulary files lie, and the one that is used unless another is named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces whose counts a worker keeps.
KEPT = 1_500_000
#: Lengths whose suffix sums are taken together, in one window partition.
BLOCK = 4096
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start and end of each piece, text of each piece), as PATTERN cuts them."""
    cp, starts = T.code_points(texts)
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return cp, z, z, z
    kind = T.classes()[cp]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    sep = starts[1:] - 1  # the newlines between texts, which belong to none
    if len(sep):
        kind = kind.copy()
        kind[sep] = 9
        new[sep] = True
        new[starts[1:][starts[1:] < n]] = True
    run = np.flatnonzero(new)
    run_end = np.append(run[1:], n)
    k = kind[run]
    # white space before something else of the same text: the last character stands apart, and a space goes to what follows
    follows = np.zeros(len(run), bool)
    follows[:-1] = (k[:-1] == T.SPACE) & (k[1:] != 9)
    last = run_end[follows] - 1
    new[last] = True
    new[last[cp[last] == 32] + 1] = False
    # 's, 't, 'm, 'd, 're, 've, 'll where the apostrophe starts a piece
    quote = np.flatnonzero((cp == 39) & new)
    if len(quote):
        ext = np.concatenate((cp, [0, 0, 0])).astype(np.uint32)
        ends = np.append(np.flatnonzero(new), n)
        a, b = ext[quote + 1], ext[quote + 2]
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for q, m in zip(quote[one | two].tolist(), np.where(one, 1, 2)[one | two].tolist()):
            new[q + 1 : q + 1 + m] = False
            if q + 1 + m < n and kind[q + 1 + m] != 9:
                new[q + 1 + m] = True
        del ends
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    real = kind[start] != 9
    start, end = start[real], end[real]
    return cp, start, end, np.searchsorted(starts, start, "right") - 1


@lru_cache(maxsize=2)
def widths(path: str) -> np.ndarray:
    """The bytes of each token."""
    ranks = encoder(path)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    out[list(ranks.values())] = [len(token) for token in ranks]
    return out


class Counter:
    """Counts tokens of texts; keeps the counts of pieces, in order of their hashes."""

    def __init__(self, path: str = VOCABULARY):
        self.encoder, self.widths = encoder(path), widths(path)
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        cp, start, end, doc = pieces(texts)
        if not len(start):
            return np.zeros(len(texts), np.int64)
        distinct, first, inverse = np.unique(T.range_hashes(cp, start, end), return_index=True, return_inverse=True)
        n = np.zeros(len(distinct), np.int64)
        at = np.searchsorted(self.known, distinct)
        inside = np.flatnonzero(at < len(self.known))
        old = inside[self.known[at[inside]] == distinct[inside]]
        n[old] = self.counts[at[old]]
        new = np.flatnonzero(n == 0)
        if len(new):
            n[new] = self.encoded(cp, start[first[new]], end[first[new]])
            self.known, self.counts = np.insert(self.known, at[new], distinct[new]), np.insert(self.counts, at[new], n[new])
            if len(self.known) > KEPT:
                self.known, self.counts = self.known[:0], self.counts[:0]
        return np.bincount(doc, n[inverse], len(texts)).astype(np.int64)

    def encoded(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The tokens of each of the pieces cp[start:end].

        Those that don't end in white space are put one behind the other, with a newline before those that don't begin with a space,
        so that PATTERN cuts them apart again, and are encoded at once; the bytes of the tokens say which belong to which piece.
        If they don't, and for white space, each piece is encoded by itself.
        """
        out = np.zeros(len(start), np.int64)
        those = np.flatnonzero(T.classes()[cp[end - 1]] != T.SPACE)
        size = end[those] - start[those]
        at = np.cumsum(size + (cp[start[those]] != 32)) - size  # where each piece begins
        within = T.run_positions(np.cumsum(size) - size, int(size.sum()))
        joined = np.full(at[-1] + size[-1] if len(at) else 0, 10, np.uint32)
        joined[np.repeat(at, size) + within] = cp[np.repeat(start[those], size) + within]
        found = self.encoder.encode_ordinary(joined.tobytes().decode("utf-32-le", "surrogatepass"))
        ends = np.concatenate(([0], np.cumsum(self.widths[np.array(found, np.int64)])))
        to = np.concatenate(([0], np.cumsum(1 + (joined >= 0x80) + (joined >= 0x800) + (joined >= 0x10000))))
        low, high = np.searchsorted(ends, to[at]), np.searchsorted(ends, to[at + size])
        if ends[-1] == to[-1] and (ends[low] == to[at]).all() and (ends[high] == to[at + size]).all():
            out[those] = high - low
        for i in np.flatnonzero(out == 0).tolist():
            out[i] = len(self.encoder.encode_ordinary(cp[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass")))
        return out


def counted(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; a map without a shuffle."""

    def run(batches):
        counter = Counter(path)
        yield from T.in_slices(lambda batch, texts: (batch.column("doc_id"), counter.count(texts)), SCHEMA)(batches)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(spark: SparkSession, lengths: DataFrame) -> DataFrame:
    """Documents by length, with suffix sums: for each length L that occurs, as a context limit,

    n_docs of that length; docs_from and tokens_from, of that length or longer;
    docs_total and tokens_total; truncated_total, what is left of all tokens when every document is cut at L;
    quantile, the share of documents of at most that length.
    The sums are taken in blocks of lengths, so that no task gets the whole histogram.
    """
    T.shared_folder(spark)
    # a row for each length that occurs, read twice below, so that texts are encoded once
    h = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK)).checkpoint()
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("b_tokens"))
    later = Window.orderBy(F.col("block").desc())
    after = later.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("after_docs"), F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("after_tokens"),
        F.sum("b_docs").over(every).alias("docs_total"), F.sum("b_tokens").over(every).alias("tokens_total"),
    )
    here = Window.partitionBy("block").orderBy(F.col("length").desc())
    out = h.join(blocks, "block").select(
        "length", "n_docs",
        (F.sum("n_docs").over(here) + F.col("after_docs")).alias("docs_from"),
        (F.sum(F.col("n_docs") * F.col("length")).over(here) + F.col("after_tokens")).alias("tokens_from"),
        "docs_total", "tokens_total",
    )
    longer = F.col("docs_from") - F.col("n_docs")
    return out.withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).withColumn("quantile", 1 - longer / F.col("docs_total"))


def token_counts(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    return histogram(spark, counted(docs, path))
