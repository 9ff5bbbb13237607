"""Near-duplicates by BagMinHash over bags of word pairs.

A document is a multiset: each pair of neighbouring words, with its count as weight.
BagMinHash draws, for each element, a Poisson process over the weights up to its
count: the dyadic weight intervals [0,1), [1,2), [2,4), ... each have a process of
their own, at a rate in proportion to their length; a point carries a component and a
place in its interval, and one whose place lies beyond the count is thinned out, as in
splitting the process down a binary tree. Each component keeps its earliest point, so
that two documents agree in a component with a probability of exactly their
weighted Jaccard similarity. Points come in ascending order and stop at a bound by
which every component is almost surely filled (documents where one isn't are drawn
further), so a document costs about COMPONENTS * (ln COMPONENTS + 4) points, whatever
its length.

Signatures are cut into BANDS. Documents with equal bags are represented by one. In
each bucket of a band, every member is compared with the least one, by the exact
overlap of the multisets. A member that all others were compared with leaves the bucket. While what is
left of a bucket holds different components, its members are compared with its least two, then 16, and so on,
unless they are connected already. So each pair that shares a bucket is either compared or connected, and a
bucket of thousands of copies takes about as many comparisons as it has members.

Defined results: documents without words (null or empty text) are in no group; a
document of one word has that word as its element; rows without a doc_id are in no
group and stay; rows that repeat a doc_id share a fate, and if their texts differ
either may link them; of a group the least doc_id stays; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import textops as T
from ..operators.dedup import components

BANDS, ROWS = 50, 5
COMPONENTS = BANDS * ROWS
#: The weighted Jaccard similarity from which documents are near-duplicates.
SIMILARITY = 0.5
#: Members of a bucket that the others are compared with in one round, at most; the number of rounds has no limit.
MOST_PIVOTS = 512
#: Bits of the table of documents whose texts are asked for; edges whose components one task finds.
ASKED, FEW_EDGES = 1 << 26, 1 << 20
_ELEMENT = np.uint64(44)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, count) of the distinct pairs of neighbouring words, by document and element. Elements have 44 bits."""
    w = T.words(texts)
    n = np.bincount(w.doc, minlength=len(texts))
    pair = T.mix(w.hash[:-1] * np.uint64(0xBF58476D1CE4E5B9) + w.hash[1:] * np.uint64(0x94D049BB133111EB))
    inside = w.doc[:-1] == w.doc[1:]
    alone = n[w.doc] == 1
    key = np.concatenate((_keyed(w.doc[:-1][inside], pair[inside]), _keyed(w.doc[alone], w.hash[alone])))
    key.sort()
    first = T.group_starts(key)
    return (key[first] >> _ELEMENT).astype(np.int64), key[first] & np.uint64((1 << 44) - 1), np.diff(np.append(first, len(key)))


def _keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (doc.astype(np.uint64) << _ELEMENT) | (h >> np.uint64(20))


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """An n x m array of the ids of the earliest points; 0 where a document has no element."""
    weight = np.bincount(doc, count, n)
    out = np.zeros((n, m), np.uint64)
    todo, reach = np.flatnonzero(weight), np.log(m) + 4
    while len(todo):
        number = np.full(n, -1)
        number[todo] = np.arange(len(todo))
        own = number[doc] >= 0
        ids, at = _earliest(number[doc[own]], element[own], count[own], len(todo), m, reach / weight[todo])
        full = np.isfinite(at).all(axis=1)
        out[todo[full]] = ids[full]
        todo, reach = todo[~full], reach * 2
    return out


def _earliest(doc, element, count, n, m, until):
    """Ids and times of the earliest points of each component, as far as they come before `until`."""
    time, ids = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    parts = [(np.arange(len(doc)), 0, 1)]
    k, low = 1, 1
    while len(some := np.flatnonzero(count > low)):
        parts.append((some, low, low))
        k, low = k + 1, low * 2
    of = np.concatenate([p[0] for p in parts])
    low = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
    length = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    seed = T.mix(element[of] * np.uint64(2) + T.mix(low.astype(np.uint64)))
    t, step, width = np.zeros(len(of)), 0, 4
    found = []
    while len(of):
        r = T.mix((seed[:, None] + (np.arange(step, step + width, dtype=np.uint64) * _STEP)[None, :]).ravel()).reshape(len(of), width)
        gap = -np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / (length * m)[:, None]
        gap[:, 0] += t
        at = np.cumsum(gap, axis=1)
        t = at[:, -1].copy()
        keep = at < until[doc[of]][:, None]
        more = low > 0
        if more.any():
            place = (T.mix(r[more].ravel() ^ _STEP) >> np.uint64(11)).reshape(-1, width).astype(np.float64) * 2.0**-53
            keep[more] &= np.floor(low[more][:, None] + place * length[more][:, None]) < count[of[more]][:, None]
        i, j = np.nonzero(keep)
        r = r[i, j]
        found.append((doc[of[i]] * m + (r & np.uint64(0xFFFFFFFF)).astype(np.int64) % m, at[i, j], r))
        go = t < until[doc[of]]
        of, low, length, seed, t = of[go], low[go], length[go], seed[go], t[go]
        step += width
        width = min(256, width * 2, max(4, 400_000 // max(1, len(of))))
    for key, at, _ in found:
        np.minimum.at(time, key, at)
    for key, at, r in found:
        won = at == time[key]
        ids[key[won]] = r[won]
    return ids.reshape(n, m), time.reshape(n, m)


def bands(signature: np.ndarray, b: int = BANDS, r: int = ROWS) -> np.ndarray:
    x = np.zeros((len(signature), b), np.uint64)
    for k in range(r):
        x = T.mix((x + signature[:, k::r][:, :b]) * _STEP + np.uint64(k + 1))
    return T.mix(x + np.arange(b, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def overlaps(a: list[str], b: list[str]) -> np.ndarray:
    """The weighted Jaccard similarity of each pair of texts."""
    (da, ea, ca), (db, eb, cb) = bags(a), bags(b)
    ka, kb = ((d.astype(np.uint64) << _ELEMENT) | e for d, e in ((da, ea), (db, eb)))
    both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = np.bincount(da[i], np.minimum(ca[i], cb[j]), len(a))
    total = np.bincount(da, ca, len(a)) + np.bincount(db, cb, len(a)) - shared
    return shared / np.maximum(total, 1)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, bag: hash of the multiset, bands: 8 bytes for each band) of the documents that have words."""
    schema = pa.schema([("doc_id", pa.int64()), ("bag", pa.int64()), ("bands", pa.binary())])

    def rows(batch, texts):
        doc, element, count = bags(texts)
        has = np.flatnonzero(np.bincount(doc, minlength=len(texts)))
        if not len(has):
            return None
        found = bands(signatures(doc, element, count, len(texts))[has])
        bag = np.zeros(len(texts), np.uint64)
        np.add.at(bag, doc, T.mix(element * _STEP + count.astype(np.uint64)))
        return batch.column("doc_id").take(pa.array(has)), T.signed(T.mix(bag[has])), [x.tobytes() for x in found]

    return T.prepared(docs, "text").where("text is not null").mapInArrow(T.in_slices(rows, schema), "doc_id long, bag long, bands binary")


def _buckets(batches):
    schema = pa.schema([("bucket", pa.int64()), ("id", pa.int64())])
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            x = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.repeat(part.column("id").to_numpy(), BANDS))], schema=schema)


def _similarities(a: list[str], b: list[str]) -> np.ndarray:
    """overlaps() of the pairs, with each different text cut into its bag only once."""
    number: dict[str, int] = {}
    i, j = (np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (a, b))
    doc, element, count = bags(list(number))
    start = np.searchsorted(doc, np.arange(len(number) + 1))
    sizes = np.bincount(doc, count, len(number))
    out = np.zeros(len(i))
    for n, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        p, q = slice(start[x], start[x + 1]), slice(start[y], start[y + 1])
        if p.stop == p.start or q.stop == q.start:
            continue
        # both are in order, so one is looked up in the other
        at = np.minimum(np.searchsorted(element[q], element[p]), q.stop - q.start - 1)
        shared = np.minimum(count[p], count[q][at])[element[q][at] == element[p]].sum()
        out[n] = shared / (sizes[x] + sizes[y] - shared)
    return out


def _asked(spark: SparkSession, pairs: DataFrame):
    """A condition on doc_id that holds for all documents of the pairs and, by a bitmap of fixed size, for few others."""

    def mark(batches):
        bits = np.zeros(ASKED // 8, np.uint8)
        for batch in batches:
            for c in ("a", "b"):
                k = (T.mix(batch.column(c).to_numpy().view(np.uint64)) % np.uint64(ASKED)).astype(np.int64)
                np.bitwise_or.at(bits, k >> 3, (1 << (k & 7)).astype(np.uint8))
        if bits.any():
            yield T.as_blocks(bits)

    bits = spark.sparkContext.broadcast(T.merged_blocks(pairs.select("a", "b").mapInArrow(mark, "block int, part int, data binary"), "or"))

    @F.pandas_udf("boolean")
    def asked(ids: pd.Series) -> pd.Series:
        k = (T.mix(ids.to_numpy(np.int64).view(np.uint64)) % np.uint64(ASKED)).astype(np.int64)
        return pd.Series((bits.value[k >> 3] >> (k & 7).astype(np.uint8)) & 1 if len(bits.value) else np.zeros(len(k))).astype(bool)

    return asked("doc_id")


def _verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b), with their other columns, whose documents are similar enough. Only their texts are shuffled."""
    schema = to_arrow_schema(pairs.schema).append(pa.field("similarity", pa.float64()))
    columns = pairs.columns

    def rows(batch, texts):
        return *(batch.column(c) for c in columns), _similarities(texts, [t or "" for t in batch.column("text_b").to_pylist()])

    some = texts.where(_asked(spark, pairs))
    joined = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.select(*columns, "text_a", "text_b")
    return joined.mapInArrow(T.in_slices(rows, schema, "text_a"), ", ".join(f"{c} long" for c in columns) + ", similarity double").where(F.col("similarity") >= SIMILARITY).drop("similarity")


def _roots(batches):
    """components() of edges that one task can hold."""
    sides = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not sides:
        return
    a, b = (np.concatenate(x) for x in zip(*sides))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(open_ := np.flatnonzero(root[u] != root[v])):
        u, v = root[u[open_]], root[v[open_]]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    schema = pa.schema([("id", pa.int64()), ("root", pa.int64())])
    for i in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(ids[root[i : i + 100_000]])], schema=schema)


def _components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """components() of a table that is written; up to FEW_EDGES in one task, without rounds."""
    if edges.limit(FEW_EDGES + 1).count() > FEW_EDGES:
        return components(spark, edges)
    return edges.select("a", "b").coalesce(1).mapInArrow(_roots, "id long, root long")


def _shared(rows: DataFrame, value: str) -> DataFrame:
    """The rows of the buckets that hold more than one value, with the least one as `low`.

    Buckets are aggregated before they are shuffled, so that no task gets the whole of a large one.
    """
    some = rows.groupBy("bucket").agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low < high").drop("high")
    return rows.join(some, "bucket")


def groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every document that has a near-duplicate; group_id is the least doc_id of the group."""
    T.shared_folder(spark)
    texts = T.prepared(docs, "text").where("text is not null")
    sketch = sketched(docs).checkpoint()
    least = sketch.groupBy("bag").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    same = sketch.select("doc_id", "bag").join(least.where("n > 1"), "bag").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    bag = sketch.groupBy("bag").agg(F.min(F.struct(F.col("doc_id").alias("id"), "bands")).alias("s")).select("s.id", "s.bands")
    members = _shared(bag.mapInArrow(_buckets, "bucket long, id long"), "id").checkpoint()
    left = members.where("id != low")
    tried = left.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct().checkpoint()
    linked = _verified(spark, tried, texts).checkpoint()
    placed = left.select("bucket", "id").join(_components(spark, linked), "id", "left").withColumn("root", F.coalesce("root", "id"))
    pivots = 2
    while True:
        left = _shared(placed, "root").drop("low").checkpoint()
        if left.isEmpty():
            break
        n = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
        chosen = left.withColumn("n", n).where(F.col("n") <= pivots).select("bucket", F.col("id").alias("pivot"), F.col("root").alias("pivot_root")).checkpoint()
        pairs = left.join(chosen, "bucket").where("root != pivot_root").select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b"), F.greatest("root", "pivot_root").alias("root_a"), F.least("root", "pivot_root").alias("root_b"))
        # a pair that another bucket has had compared isn't compared again
        pairs = pairs.distinct().join(tried, ["a", "b"], "left_anti").checkpoint()
        new = _verified(spark, pairs, texts).checkpoint()
        tried, linked = tried.union(pairs.select("a", "b")), linked.union(new.select("a", "b"))
        left = left.join(chosen.select("bucket", F.col("pivot").alias("id")), ["bucket", "id"], "left_anti")
        # only groups that this round links get another root
        merged = _components(spark, new.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        placed = left.join(merged.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("bucket", "id", F.coalesce("to", "root").alias("root"))
        pivots = min(8 * pivots, MOST_PIVOTS)
    found = _components(spark, linked.union(same).checkpoint())
    return found.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"))


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without all but the least of each group, with all their columns."""
    gone = groups(spark, docs).where("doc_id != group_id").select(F.col("doc_id").alias(T.unused(docs, "gone")))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[gone.columns[0]], "left_anti")
