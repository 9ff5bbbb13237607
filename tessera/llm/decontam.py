"""Benchmark decontamination by spaced seeds.

Fixed masks select some of the tokens of each span of text and ignore the others, so
that a seed still matches where ignored tokens were substituted. Seeds of the
benchmark and of the documents are joined by hash. Around each hit the benchmark
item is laid along the document's tokens and the best-matching segment is taken,
substitutions allowed; what such segments cover of an item, over all its
alignments, decides. A document is contaminated by an item when MIN_SHARE of the
item's tokens is covered, with at least MIN_TOKENS of them (or all, of a shorter item).

A bitmap over the benchmark's seeds keeps documents' other seeds from being shuffled. Its size
follows the counted benchmark, up to 2 ** MOST_LOG bits (128 MB); a larger benchmark fills it more, which costs
shuffle and loses nothing. A seed that a text repeats is one row with its runs of places, so that
repetitive texts don't multiply in the join. Items shorter than the span get one seed of their own length,
which ignores nothing.

Defined results: null and empty texts and items without tokens match nothing; rows
without a doc_id are never contaminated, and stay; items without an item_id are left
out; of repeated doc_ids or item_ids every text counts, and the highest share is
given; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T

#: Which tokens of a span a seed takes.
MASKS = ("1101101011", "1110010111", "1011101101", "1101011011")
SPAN = len(MASKS[0])
MIN_SHARE, MIN_TOKENS = 0.5, 8
#: Bits of the bitmap for each seed of the benchmark, and the least and greatest logarithm of its size.
BITS_A_SEED, LEAST_LOG, MOST_LOG = 16, 20, 30
_TIMES = T.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def seeds(hashes: np.ndarray, doc: np.ndarray, taken: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position over all tokens) of the seeds with the offsets `taken` that lie within one text."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.full(n, np.uint64(span))
    for k, o in enumerate(taken):
        x += hashes[o : o + n] * _TIMES[(k + 7 * o) % 64]
    at = np.flatnonzero(doc[:n] == doc[span - 1 :])
    return T.mix(x[at]), at


def _first(doc: np.ndarray, n: int) -> np.ndarray:
    """The index of each text's first token."""
    return np.searchsorted(doc, np.arange(n))


def _shapes(short: list[int]) -> list[tuple[list[int], int]]:
    return [([i for i, c in enumerate(m) if c == "1"], SPAN) for m in MASKS] + [(list(range(n)), n) for n in short]


def align(item: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> int:
    """How many of the item's tokens segments along these diagonals cover with equal tokens.

    A segment gains 1 for each equal token and loses 2 for each other one. Of a diagonal with a seed hit, the segment that gains
    most counts, and around each hit the one that gains most among those that hold the hit. Diagonals without a hit
    count nothing, so `diagonals` may hold more than those with hits.
    """
    covered = np.zeros(len(item), bool)
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(text) - d)
        if lo >= hi:
            continue
        same = item[lo:hi] == text[lo + d : hi + d]
        n = len(same)
        if len(item) < SPAN:
            if n == len(item) and same.all():
                return n
            continue
        if n < SPAN:
            continue
        hit = np.flatnonzero(np.logical_or.reduce([np.logical_and.reduce([same[k : n - SPAN + 1 + k] for k, c in enumerate(m) if c == "1"]) for m in MASKS]))
        if not len(hit):
            continue
        total = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
        least = np.minimum.accumulate(total)
        most = np.maximum.accumulate(total[::-1])[::-1]
        # where the best segment up to a place starts, and where the best one from there ends; of equal ones the longest
        start = np.maximum.accumulate(np.where(np.append(True, total[1:] < least[:-1]), np.arange(n + 1), 0))
        end = np.minimum.accumulate(np.where(np.append(total[:-1] > most[1:], True), np.arange(n + 1), n)[::-1])[::-1]
        best = int((total - least).argmax())
        for i, j in {(start[best], end[best]), *zip(start[hit], end[hit + SPAN])}:
            covered[lo + i : lo + j] |= same[i:j]
        if covered.all():
            break
    return int(covered.sum())


def _runs(rows: np.ndarray, seed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, seed) of each text and seed; the runs of all, as first and last places by turns; and where those of each start.

    Occurrences within SPAN places of each other are one run, so that a text of equal words has one run and not thousands.
    """
    order = np.lexsort((at, seed, rows))
    rows, seed, at = rows[order], seed[order], at[order]
    other = np.ones(len(at), bool)
    other[1:] = (rows[1:] != rows[:-1]) | (seed[1:] != seed[:-1])
    new = other.copy()
    new[1:] |= at[1:] - at[:-1] > SPAN
    start = np.flatnonzero(new)
    ends = np.append(start[1:], len(at)) - 1 if len(start) else start
    flat = np.stack([at[start], at[ends]], axis=1).astype(np.int32).ravel()
    first = np.flatnonzero(other)
    bounds = 2 * np.searchsorted(start, np.append(first, len(at)))
    return rows[first], seed[first], flat, bounds.astype(np.int32)


def _diagonals(text_runs: list, item_runs: list) -> np.ndarray:
    """All places of the item's start in the text that some seed's runs allow, in ascending order."""
    spans = []
    for t, i in zip(text_runs, item_runs):
        t, i = np.asarray(t, np.int64).reshape(-1, 2), np.asarray(i, np.int64).reshape(-1, 2)
        spans.append(np.stack([(t[:, None, 0] - i[None, :, 1]).ravel(), (t[:, None, 1] - i[None, :, 0]).ravel()]))
    lo, hi = np.concatenate(spans, axis=1)
    base = int(lo.min())
    step = np.zeros(int(hi.max()) - base + 2, np.int64)
    np.add.at(step, lo - base, 1)
    np.add.at(step, hi - base + 1, -1)
    return np.flatnonzero(np.cumsum(step)) + base


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, share) of each document and benchmark item that it contains."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")

    def sizes(batches):
        for batch in batches:
            for _, _, texts in T.slices(batch):
                n = np.bincount(T.words(texts).doc, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[(n > 0) & (n < SPAN)]), pa.int64())], names=["n"])

    short = sorted(r.n for r in items.mapInArrow(sizes, "n long").distinct().collect())  # fewer than SPAN values
    shapes = _shapes(short)

    def found(w, texts, known, ids, log):
        """The seeds of some texts, those of the bitmap only where there is one."""
        first, n = _first(w.doc, len(texts)), np.bincount(w.doc, minlength=len(texts))
        parts = []
        for taken, span in shapes:
            h, at = seeds(w.hash, w.doc, taken, span)
            if known is None:
                if span < SPAN:
                    h, at = h[n[w.doc[at]] == span], at[n[w.doc[at]] == span]
            else:
                b = _bucket(h, log)
                some = np.flatnonzero((known[b >> 3] >> (b & 7).astype(np.uint8)) & 1) if len(known) else np.zeros(0, np.int64)
                h, at = h[some], at[some]
            parts.append((w.doc[at], h, at - first[w.doc[at]]))
        text, seed, flat, bounds = _runs(*(np.concatenate(c) for c in zip(*parts)))
        return T.signed(seed), ids[text], pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))

    def item_seeds(batches):
        schema = pa.schema([("seed", pa.int64()), ("item_id", pa.int64()), ("item_runs", pa.list_(pa.int32()))])
        rows = lambda batch, texts: found(T.words(texts), texts, None, batch.column("item_id").to_numpy(zero_copy_only=False), 0)
        yield from T.in_slices(rows, schema)(batches)

    T.shared_folder(spark)
    from_items = items.mapInArrow(item_seeds, "seed long, item_id long, item_runs array<int>").checkpoint()
    log = min(MOST_LOG, max(LEAST_LOG, (BITS_A_SEED * from_items.count()).bit_length()))

    def bitmap(batches):
        bits = np.zeros((1 << log) // 8, np.uint8)
        for batch in batches:
            at = _bucket(batch.column("seed").to_numpy().view(np.uint64), log)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield T.as_blocks(bits)

    bits = spark.sparkContext.broadcast(T.merged_blocks(from_items.select("seed").mapInArrow(bitmap, "block int, part int, data binary"), "or"))

    def doc_seeds(batches):
        schema = pa.schema([("seed", pa.int64()), ("doc_id", pa.int64()), ("runs", pa.list_(pa.int32()))])
        rows = lambda batch, texts: found(T.words(texts), texts, bits.value, batch.column("doc_id").to_numpy(zero_copy_only=False), log)
        yield from T.in_slices(rows, schema)(batches)

    texts = T.prepared(docs, "text").where("text is not null")
    hits = texts.mapInArrow(doc_seeds, "seed long, doc_id long, runs array<int>").join(from_items, "seed")
    pairs = hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.struct("runs", "item_runs")).alias("runs"))
    pairs = pairs.join(items.withColumnRenamed("text", "item_text"), "item_id").join(texts, "doc_id")

    def verify(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("item_tokens", pa.int32())])

        def rows(batch, texts):
            w = T.words(texts)
            v = T.words(batch.column("item_text").to_pylist())
            n = range(len(texts) + 1)
            a, b = np.searchsorted(w.doc, n), np.searchsorted(v.doc, n)
            got = []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                at = _diagonals([r["runs"] for r in runs], [r["item_runs"] for r in runs])
                got.append(align(v.hash[b[i] : b[i + 1]], w.hash[a[i] : a[i + 1]], at))
            return batch.column("doc_id"), batch.column("item_id"), got, np.diff(b)

        yield from T.in_slices(rows, schema)(batches)

    checked = pairs.select("doc_id", "item_id", "runs", "item_text", "text").mapInArrow(verify, "doc_id long, item_id long, matched int, item_tokens int")
    least = F.greatest(F.col("item_tokens") * MIN_SHARE, F.least(F.col("item_tokens"), F.lit(MIN_TOKENS)))
    best = F.max_by(F.struct("matched", "item_tokens"), F.col("matched") / F.col("item_tokens"))
    found = checked.where(F.col("matched") >= least).groupBy("doc_id", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "item_id", "b.matched", "b.item_tokens", (F.col("b.matched") / F.col("b.item_tokens")).alias("share"))


def _bucket(h: np.ndarray, log: int) -> np.ndarray:
    return (h >> np.uint64(64 - log)).astype(np.int64)


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    bad = contaminated(spark, docs, benchmark).select(F.col("doc_id").alias(T.unused(docs, "bad"))).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[bad.columns[0]], "left_anti")
