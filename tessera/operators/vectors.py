"""Vector search: exact, by keys and groups, and in two stages through binary codes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import dot, finite, quantize
from ..sources.shared import shared_folder
from .aggregates import upper_medians

#: Bytes of queries that are broadcast; more are paired with the rows by blocks.
BROADCAST_BYTES = 64 << 20
#: Rows of a block of such a pairing, about, on either side.
BLOCK_ROWS = 20_000
#: Vectors of a block whose pairs are all rows of a result.
PAIR_ROWS = 1000
#: Pairs that a worker compares at once.
AT_ONCE = 1 << 22
#: Scores are compared after rounding to so many digits, since the order of a sum's terms isn't fixed.
DIGITS = 9


def indexed(rows: DataFrame, dim: int, group: str = "grp", index: str = "chunk_index", vector: str = "v") -> tuple[DataFrame, DataFrame]:
    """(usable rows, report): rows of another dimension, with values that aren't finite, or that repeat a key are skipped and counted."""
    good = F.coalesce((F.size(vector) == dim) & finite(F.col(vector)), F.lit(False))
    n = F.row_number().over(Window.partitionBy(group, index, good).orderBy(F.xxhash64(vector)))
    marked = rows.withColumn("__good", good).withColumn("__n", n)
    report = marked.agg(
        F.count("*").alias("total"), F.count_if(F.col("__good") & (F.col("__n") == 1)).alias("indexed"), F.count_if(~F.col("__good") & (F.size(vector) != dim)).alias("wrong_dimension"),
        F.count_if(~F.col("__good") & (F.size(vector) == dim)).alias("not_finite"), F.count_if(F.col("__good") & (F.col("__n") > 1)).alias("duplicate_keys"),
    )
    return marked.where("__good and __n = 1").drop("__good", "__n"), report


def _bytes(c: str, kind: str) -> Column:
    """About what a value takes in memory."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if kind.startswith("array"):
        each = F.lit(8) if "string" not in kind else F.lit(32)
        return F.greatest(F.size(c), F.lit(0)) * each + 16
    return F.lit(16)


def measured(rows: DataFrame) -> tuple[int, int]:
    """(rows, bytes), counted in one pass."""
    size = sum((_bytes(c, t) for c, t in rows.dtypes), F.lit(0))
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("b")).first()
    return r.n, r.b


def small(rows: DataFrame) -> DataFrame:
    """The rows, marked to be broadcast if they are of BROADCAST_BYTES at most, after they were measured."""
    return F.broadcast(rows) if measured(rows)[1] <= BROADCAST_BYTES else rows


def paired(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every query with every vector. Queries of BROADCAST_BYTES at most are broadcast, after they were measured; more meet the vectors in
    as many blocks as keep a block's queries below that."""
    _, size = measured(queries)
    if size <= BROADCAST_BYTES:
        return vectors.crossJoin(F.broadcast(queries))
    m, n = math.ceil(size / BROADCAST_BYTES), 32
    q = queries.withColumn("__q", F.pmod(F.xxhash64(queries.columns[0]), F.lit(m)).cast("int")).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    v = vectors.withColumn("__b", F.pmod(F.xxhash64(*vectors.columns[:2]), F.lit(n)).cast("int")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return v.join(q, ["__b", "__q"]).drop("__b", "__q")


def matrix(values: list, dim: int) -> np.ndarray:
    """Rows of one length as a matrix; zeros for those that are missing or of another length."""
    out = np.zeros((len(values), dim))
    good = [i for i, v in enumerate(values) if v is not None and len(v) == dim]
    if good:
        out[good] = np.array([values[i] for i in good], float)
    return out


def in_blocks(queries: DataFrame, rows: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn(queries, rows) of frames of both sides, such that each query meets each row in exactly one call.

    Queries of BROADCAST_BYTES at most are sent to all workers once, and rows stay where they are. More are dealt into blocks,
    and so are the rows; each pair of blocks is one call, of a bounded size on both sides.
    """

    def parts(a: pd.DataFrame, b: pd.DataFrame):
        step = max(1, AT_ONCE // max(1, len(b)))
        for i in range(0, len(a) if len(b) else 0, step):
            yield fn(a.iloc[i : i + step], b)

    n, size = measured(queries)
    if size <= BROADCAST_BYTES:
        shared = queries.sparkSession.sparkContext.broadcast(queries.toPandas())

        def run(batches):
            for pdf in batches:
                yield from parts(shared.value, pdf)

        return rows.mapInPandas(run, schema)
    m = math.ceil(max(size / BROADCAST_BYTES, n / BLOCK_ROWS))
    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # both sides may be of one table
    k = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    q = queries.withColumn("__q", F.pmod(F.xxhash64(queries.columns[0]), F.lit(m)).cast("int")).withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    v = rows.withColumn("__v", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(k)).cast("int")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = list(parts(*(x.drop(columns=["__q", "__v"]) for x in (a, b))))
        return pd.concat(made) if made else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return q.groupBy("__q", "__v").cogroup(v.groupBy("__q", "__v")).applyInPandas(both, schema)


def best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of every score that can be among its row's k highest: those not below the k-th, so that ties stay open."""
    n = scores.shape[1]
    if k >= n:
        return np.nonzero(np.ones(scores.shape, bool))
    least = np.partition(scores, n - k, axis=1)[:, n - k : n - k + 1]
    return np.nonzero(scores >= least)


def near_best(scores: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """As best_places(), in less time; gives some more, at least all within `slack` of the k-th."""
    rows, n = scores.shape
    g = n // 32
    if g < 2 * k:
        least = np.partition(scores, n - k, axis=1)[:, n - k] if k < n else np.full(rows, -np.inf)
    else:  # the k-th of the groups' highest isn't above the k-th of all
        least = np.partition(scores[:, : g * 32].reshape(rows, g, 32).max(2), g - k, axis=1)[:, g - k]
    return np.nonzero(scores >= (least - slack)[:, None])


def first_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of its row's k highest scores; of equal ones, those of the lower columns."""
    if k <= 0 or not scores.size:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = best_places(scores, k)
    if k < scores.shape[1]:
        start = np.searchsorted(i, np.arange(len(scores)))
        tied = scores[i, j] == np.minimum.reduceat(scores[i, j], start)[i]
        before = np.cumsum(tied) - tied
        keep = ~tied | (before - before[start][i] < k - np.bincount(i, ~tied, len(scores))[i])
        i, j = i[keep], j[keep]
    return i, j


def _types(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in names)


def _best(scored: DataFrame, k: int, order: list[Column], query_id: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).where(F.col("rank") <= k)


def exact_search(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = 0.0, query_id: str = "query_id", keys: list[str] | None = None) -> DataFrame:
    """The k vectors with the highest dot product for each query (query_id, q); 10 for k of 0 or less; `least` counts only if positive.

    Products of matrices, block by block; only k candidates of a block are shuffled for each query. Vectors of another length than
    the query score 0.
    """
    keys = keys or ["grp", "chunk_index"]
    k = k if k > 0 else 10

    return _products(queries, vectors, k, query_id, keys, lambda s: s >= least if least > 0 else np.ones(len(s), bool), False)


def _products(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, keys: list[str], enough: Callable, same: bool) -> DataFrame:
    """The k best by rounded dot products, block by block, of those that are enough; same: other lengths than the query's are skipped, else they score 0."""
    held: list = [None, {}]

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if held[0] is not v:
            held[:] = [v, {}]  # a block of rows is made a matrix once
        for dim, some in q.groupby(q.q.map(lambda x: len(x) if x is not None else 0)):
            if dim not in held[1]:
                held[1][dim] = matrix(v.v.tolist(), dim), v.v.map(lambda x: x is not None and len(x) == dim).to_numpy(bool)
            m, fits = held[1][dim]
            s = matrix(some.q.tolist(), dim) @ m.T
            if same:
                s[:, ~fits] = -np.inf
            i, j = near_best(s, k, 2 * 10.0**-DIGITS)
            score = np.round(s[i, j], DIGITS) + 0.0
            has = (score > -np.inf) & enough(score)
            i, j, score = i[has], j[has], score[has]
            parts.append(pd.DataFrame({query_id: some[query_id].to_numpy()[i], **{c: v[c].to_numpy()[j] for c in keys}, "score": score}))
        return pd.concat(parts)

    q, rows = queries.select(query_id, "q"), vectors.select(*keys, "v")
    scored = in_blocks(q, rows, run, f"{_types(q, [query_id])}, {_types(rows, keys)}, score double")
    return _best(scored, k, [F.desc("score"), *keys], query_id)


def search_keys(queries: DataFrame, vectors: DataFrame, wanted: DataFrame, k: int = 10, least: float = 0.0, query_id: str = "query_id", keys: list[str] | None = None) -> DataFrame:
    """Exact search over the vectors with the wanted keys only; repeated keys count once, and none match nothing."""
    keys = keys or ["grp", "chunk_index"]
    if query_id not in wanted.columns:
        return exact_search(queries, vectors.join(wanted.select(*keys).distinct(), keys, "left_semi"), k, least, query_id, keys)
    k = k if k > 0 else 10
    scored = wanted.select(query_id, *keys).distinct().join(vectors.select(*keys, "v"), keys).join(queries.select(query_id, "q"), query_id).select(query_id, *keys, dot(F.col("q"), F.col("v")).alias("score"))
    if least > 0:
        scored = scored.where(F.col("score") >= least)
    return _best(scored, k, [F.desc("score"), *keys], query_id)


def search_groups(queries: DataFrame, vectors: DataFrame, groups: list, k: int = 10, least: float = 0.0) -> DataFrame:
    """Exact search within whole groups."""
    return exact_search(queries, vectors.where(F.col("grp").isin(list(groups))), k, least)


def binary_codes(vectors: DataFrame, medians: DataFrame, vector: str = "v") -> DataFrame:
    """The vectors with packed codes: a bit is set where the value is above its dimension's median."""
    row = medians.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "median"))), lambda p: p["median"]).alias("__t"))  # one row
    return vectors.crossJoin(F.broadcast(row)).withColumn("code", quantize(F.col(vector), F.col("__t"))).drop("__t")


def hamming_candidates(queries: DataFrame, codes: DataFrame, limit: int = 100, query_id: str = "query_id", keys: list[str] | None = None) -> DataFrame:
    """The `limit` vectors with the nearest codes for each query (query_id, code); none for 0 or less."""
    keys = keys or ["grp", "chunk_index"]

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for words, some in q.groupby(q.code.map(len)):
            same = v.code.map(len).to_numpy() == words
            codes = np.zeros((len(v), words), np.int64)
            codes[same] = np.array(v.code[same].tolist(), np.int64).reshape(-1, words)
            a = np.array(some.code.tolist(), np.int64).reshape(-1, words)
            d = sum((np.bitwise_count((a[:, w, None] ^ codes[None, :, w]).view(np.uint64)).astype(np.int32) for w in range(words)), np.zeros((len(a), len(v)), np.int32))
            d[:, ~same] = 0
            i, j = best_places(-d, limit)
            parts.append(pd.DataFrame({query_id: some[query_id].to_numpy()[i], **{c: v[c].to_numpy()[j] for c in keys}, "distance": d[i, j]}))
        return pd.concat(parts)

    q, rows = queries.select(query_id, "code"), codes.select(*keys, "code")
    if limit <= 0:
        return q.join(rows.drop("code"), F.lit(False)).select(query_id, *keys, F.lit(0).alias("distance"), F.lit(0).alias("rank"))
    scored = in_blocks(q, rows, run, f"{_types(q, [query_id])}, {_types(rows, keys)}, distance int")
    return _best(scored, limit, [F.asc("distance"), *keys], query_id)


def numbered(rows: DataFrame, order: str | list[str], name: str = "index") -> DataFrame:
    """The rows with their places from 0 in ascending order: sorted in ranges, each of which starts behind the rows of those before it."""
    shared_folder(rows.sparkSession)
    order = [order] if isinstance(order, str) else order
    ranged = rows.repartitionByRange(*(F.col(c) for c in order)).withColumn("__p", F.spark_partition_id()).checkpoint()
    start, at = {}, 0
    for r in sorted(ranged.groupBy("__p").count().collect(), key=lambda r: r["__p"]):  # a row for each range
        start[r["__p"]], at = at, at + r["count"]
    first = rows.sparkSession.createDataFrame(list(start.items()), "__p int, __s long")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__n", place).join(F.broadcast(first), "__p").withColumn(name, F.col("__n") + F.col("__s")).drop("__p", "__n", "__s")


class HammingStage:
    """Distances of packed codes: from queries to all of them, which are on all workers in order, or to some."""

    slack = 0.0

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # by place and word

    def ready(self, q: pd.DataFrame):
        return np.array(q.code.tolist(), np.int64).reshape(len(q), -1)

    def every(self, made) -> np.ndarray:
        return sum(np.bitwise_count((made[:, w, None] ^ self.codes[None, :, w]).view(np.uint64)).astype(np.int16) for w in range(made.shape[1]))

    def some(self, made, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.bitwise_count((made[i] ^ self.codes[at]).view(np.uint64)).sum(1).astype(np.int64)

    def rounded(self, d: np.ndarray) -> np.ndarray:
        return d


def cut(stage, made, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the rounded distance of the last of its `limit` nearest, ties by place, and the place of it."""
    d = stage.every(made)
    n = d.shape[1]
    if limit >= n:
        return np.full(len(d), np.inf), np.full(len(d), n)
    last, place = np.zeros(len(d)), np.zeros(len(d), np.int64)
    for r, kth in enumerate(np.partition(d, limit - 1, axis=1)[:, limit - 1]):
        slack = stage.slack * (1 + abs(float(kth)))
        near = np.nonzero(np.abs(d[r] - kth) <= slack)[0] if slack else np.nonzero(d[r] == kth)[0]
        value, t = stage.rounded(d[r][near]), stage.rounded(kth)
        below = int((d[r] < kth - slack).sum()) + int((value < t).sum())
        last[r], place[r] = t, near[value == t][limit - below - 1]
    return last, place


def staged(queries: DataFrame, rows: DataFrame, stage, k: int, limit: int, query_id: str, keys: list[str], euclidean: bool = False) -> DataFrame:
    """The k best by exact scores, rounded ones before ties by keys, of each query's `limit` nearest by a stage's distances; ties of these by place.

    queries: (query_id, q, what the stage reads); rows: (keys, v, place). The candidates, a share of all pairs, are never written: a first
    pass gives where each query's end, a second one takes the best of each block of rows that lie before that.
    """
    shared = queries.sparkSession.sparkContext.broadcast(stage)
    n = max(1, rows.count())
    columns, kinds = queries.columns, ", ".join(f"{c} {t}" for c, t in queries.dtypes)
    step = max(1, AT_ONCE // n)

    def ends(batches):
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                last, place = cut(shared.value, shared.value.ready(part), limit)
                yield part.assign(last=last, place=place)

    dealt = queries.repartition(max(1, math.ceil(queries.count() * n / (1 << 28))))
    asked = dealt.mapInPandas(ends, f"{kinds}, last double, place long").checkpoint()
    held: list = [None, None]

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        stage = shared.value
        parts = []
        made, last, place, at = stage.ready(q), q["last"].to_numpy(), q.place.to_numpy(), v.place.to_numpy()
        if held[0] is not v:
            held[:] = [v, {}]

        def kept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            d = stage.rounded(stage.some(made, i, at[j]))
            return (d < last[i]) | ((d == last[i]) & (at[j] <= place[i]))

        size = q.q.map(lambda x: len(x) if x is not None else 0).to_numpy()
        for dim in np.unique(size):
            mine = np.nonzero(size == dim)[0]
            if dim not in held[1]:
                m = matrix(v.v.tolist(), dim)
                held[1][dim] = m, (m * m).sum(1)
            (m, square), x = held[1][dim], matrix(q.q.iloc[mine].tolist(), dim)
            s = x @ m.T
            if euclidean:
                s = 2 * s - square - (x * x).sum(1)[:, None]
            i, j = near_best(s, 4 * k, 1e-8)
            good = kept(mine[i], j)
            few = np.nonzero(np.bincount(i[good], minlength=len(mine)) < min(k, s.shape[1]))[0]
            if len(few):  # the best of the block aren't candidates: all rows are looked at
                fi, fj = np.repeat(few, s.shape[1]), np.tile(np.arange(s.shape[1]), len(few))
                is_few = np.isin(i, few)
                i, j = np.concatenate([i[~is_few], fi]), np.concatenate([j[~is_few], fj])
                good = kept(mine[i], j)
            i, j = i[good], j[good]
            exact = -np.sqrt(((x[i] - m[j]) ** 2).sum(1)) if euclidean else s[i, j]
            score = np.round(exact, DIGITS) + 0.0
            best = np.lexsort((at[j], -score, i))
            best = best[np.arange(len(i)) - np.searchsorted(i[best], i[best]) < k]
            i, j, exact, score = i[best], j[best], exact[best], score[best]
            parts.append(pd.DataFrame({query_id: q[query_id].to_numpy()[mine[i]], **{c: v[c].to_numpy()[j] for c in keys}, "score": score, "exact": exact}))
        return pd.concat(parts)

    scored = in_blocks(asked.select(*columns, "last", "place"), rows.select(*keys, "v", "place"), run, f"{_types(queries, [query_id])}, {_types(rows, keys)}, score double, exact double")
    return _best(scored, k, [F.desc("score"), *keys], query_id)


def two_stage(queries: DataFrame, vectors: DataFrame, k: int = 5, candidates: int | None = None, query_id: str = "query_id", keys: list[str] | None = None) -> DataFrame:
    """Candidates by binary codes, re-ranked exactly. Approximate: `candidates` trades recall for work.

    Unless given, they are a quarter of the vectors, 100 at least: a fixed number finds less and less as the table grows. Codes of
    BROADCAST_BYTES at most are on all workers (8 bytes for 64 dimensions); more, or codes of several lengths, are paired by blocks.
    """
    keys = keys or ["grp", "chunk_index"]
    n = vectors.count()
    if candidates is None:
        candidates = max(100, -(-n // 4))
    medians = upper_medians(vectors, "v")
    codes = binary_codes(vectors, medians)
    q = binary_codes(queries.withColumnRenamed("q", "v"), medians).withColumnRenamed("v", "q")
    sizes = {r.n for r in codes.select(F.size("code").alias("n")).union(q.select(F.size("code"))).distinct().collect()}
    if k <= 0 or candidates <= 0 or len(sizes) != 1 or (words := sizes.pop()) < 1 or 8 * words * n > BROADCAST_BYTES:
        found = hamming_candidates(q, codes, candidates, query_id, keys)
        return search_keys(queries, vectors, found, k, query_id=query_id, keys=keys)
    placed = numbered(codes.select(*keys, "v", "code"), keys, "place").checkpoint()
    table = placed.select("place", "code").toArrow()
    every = table.column("code").combine_chunks().flatten().to_numpy().reshape(-1, words)
    return staged(q.select(query_id, "q", "code"), placed, HammingStage(every[np.argsort(table.column("place").to_numpy())]), k, candidates, query_id, keys).drop("exact")


def distances_within(rows: DataFrame, group: str, id_column: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(a, b, cosine_distance, euclidean), a < b, of every pair of one group, rounded.

    Blocks of about PAIR_ROWS vectors of a group are paired; a pair of blocks is one task's product of two matrices. A group's pairs are quadratic, and all are rows.
    """
    counts = rows.groupBy(F.col(group).alias("g")).agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("m"))  # a row for each group
    dealt = rows.select(F.col(group).alias("g"), F.col(id_column).alias("id"), F.col(vector).alias("v")).join(small(counts), "g")
    dealt = dealt.withColumn("o", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    pair = lambda o: F.struct(F.least(F.col("o"), o).alias("x"), F.greatest(F.col("o"), o).alias("y"))
    dealt = dealt.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), pair))).select("g", "id", "v", "o", "p.x", "p.y")
    kind = dict(dealt.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": pdf.id[:0], "b": pdf.id[:0], "cosine_distance": np.zeros(0), "euclidean": np.zeros(0)})]
        size = pdf.v.map(lambda v: len(v) if v is not None else -1).to_numpy()
        one = pdf.x.iloc[0] == pdf.y.iloc[0]
        sides = [pdf.index[pdf.o == pdf[c]] for c in ("x", "y")]
        for m in np.unique(size):
            for n in np.unique(size):
                left, right = (pdf.loc[side[size[side] == d]] for side, d in zip(sides, (m, n)))
                a, b = left.id.to_numpy(), right.id.to_numpy()
                i, j = np.nonzero(a[:, None] < b[None, :] if one else a[:, None] != b[None, :])
                far, apart = np.ones(len(i)), np.full(len(i), np.inf)
                if m == n > 0:
                    x, y = matrix(left.v.tolist(), m), matrix(right.v.tolist(), n)
                    sx, sy, s = (x * x).sum(1), (y * y).sum(1), x @ y.T
                    length = np.sqrt(sx)[:, None] * np.sqrt(sy)[None, :]
                    far = (1 - np.clip(np.where(length > 0, s / np.where(length > 0, length, 1), 0), -1, 1))[i, j]
                    scale = sx[i] + sy[j]
                    square = scale - 2 * s[i, j]
                    close = square < 1e-3 * scale  # differences of nearly equal numbers are taken again
                    square[close] = ((x[i[close]] - y[j[close]]) ** 2).sum(1)
                    apart = np.sqrt(square)
                half = lambda d: np.floor(d * 10.0**digits + 0.5) / 10.0**digits
                out.append(pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "cosine_distance": half(far), "euclidean": half(apart)}))
        return pd.concat(out)

    return dealt.groupBy("g", "x", "y").applyInPandas(run, f"a {kind}, b {kind}, cosine_distance double, euclidean double")


def top_k_indices(rows: DataFrame, value: str, index: str, k: int, largest: bool = True) -> DataFrame:
    """The k rows with the largest or smallest values, ties by index."""
    return rows.orderBy(F.desc(value) if largest else F.asc(value), index).limit(max(k, 0))


def top_k_valid(queries: DataFrame, vectors: DataFrame, k: int, least: float, query_id: str = "query_id", keys: list[str] | None = None) -> DataFrame:
    """As exact search, over vectors that may be of the wrong length or not finite, which are skipped; `least` is inclusive."""
    keys = keys or ["grp", "chunk_index"]
    if k <= 0:
        k, least = 1, math.inf
    return _products(queries.where(F.size("q") >= 0), vectors.where(finite(F.col("v"))), k, query_id, keys, lambda s: s >= least, True)
