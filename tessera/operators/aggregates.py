"""Aggregations over texts, vectors and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_tokens
from ..functions.vector import norm


def top_keywords(docs: DataFrame, k: int = 10, min_length: int = 4, min_count: int = 1, by: list[str] | None = None, include=None, **options) -> DataFrame:
    """The k most frequent keywords (of each group), ties by term; `include` is a further condition on the column `term`."""
    by = by or []
    terms = docs.select(*by, F.explode(keyword_tokens("text", min_length, **options)).alias("term"))
    if include is not None:
        terms = terms.where(include)
    counts = terms.groupBy(*by, "term").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    if not by:
        return counts.orderBy(F.desc("n"), "term").limit(k)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)


def most_frequent(rows: DataFrame, value: Column, by: list[str], least: int = 1, fallback: str = "") -> DataFrame:
    """The most frequent trimmed value of each group that occurs `least` times, ties by value; else the fallback."""
    counts = rows.select(*by, F.trim(value).alias("v")).groupBy(*by, "v").agg(F.count("*").alias("n"))
    good = F.when((F.coalesce("v", F.lit("")) != "") & (F.col("n") >= least), F.struct((-F.col("n")).alias("o"), F.col("v").alias("v")))
    return counts.groupBy(*by).agg(F.coalesce(F.min(good)["v"], F.lit(fallback)).alias("value"))


def themes(docs: DataFrame, keywords: dict[str, list[str]], fallback: str = "general", id_column: str = "doc_id") -> DataFrame:
    """The theme with the most white-space tokens equal to its keywords, ties to the first by name; no trimming of punctuation."""
    tokens = F.split(F.lower("text"), r"\s+")

    def count(words: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*[w.lower() for w in words])))

    score = [F.struct((-count(words)).alias("o"), F.lit(name).alias("theme")) for name, words in sorted(keywords.items()) if words]
    best = F.array_min(F.array(*score))
    return docs.select(id_column, F.when(best["o"] < 0, best["theme"]).otherwise(fallback).alias("theme"))


def mean_stddev(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean and population deviation; zeros for nothing."""
    return rows.groupBy(*(by or [])).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("stddev"))


def dimensions(vectors: DataFrame, by: list[str], vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """(by, dim, x, w): the vectors' values, dimension by dimension."""
    return vectors.select(*by, (weight if weight is not None else F.lit(1.0)).alias("w"), F.posexplode(vector).alias("dim", "x"))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Single-precision values as integers in the same order."""
    u = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(u >> 31, ~u, u | np.uint32(1 << 31))


def _value(u: int) -> float:
    bits = np.array([u & 0x7FFFFFFF if u >> 31 else ~u & 0xFFFFFFFF], np.uint32)
    return float(bits.view(np.float32)[0])


def upper_medians(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, median): the upper middle value of each dimension; vectors of different lengths are an error.

    By exact selection in two passes that count: of the upper 16 bits of each value, then of the lower 16 among those in the
    middle. Neither pass sorts, and each result is at most 65,536 counts for each dimension.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.count_if(F.size(vector) >= 0).alias("n")).first()
    if size.lo != size.hi:
        raise ValueError(f"vectors have {size.lo} to {size.hi} dimensions")
    if not size.n or not size.hi or size.hi < 0:
        return spark.createDataFrame([], "dim int, median float")

    def counts(middle: np.ndarray | None):
        def run(batches):
            total: dict[tuple[int, int], int] = {}
            for pdf in batches:
                u = _sortable(np.array(pdf.v.tolist(), np.float32).reshape(len(pdf), -1))
                for d in range(u.shape[1]):
                    part = u[:, d] >> 16 if middle is None else u[:, d][u[:, d] >> 16 == middle[d]] & 0xFFFF
                    for key, n in zip(*(x.tolist() for x in np.unique(part, return_counts=True))):
                        total[d, key] = total.get((d, key), 0) + n
            if total:
                yield pd.DataFrame({"dim": [d for d, _ in total], "part": [k for _, k in total], "n": list(total.values())})

        parts = vectors.where(F.size(vector) >= 0).select(F.col(vector).alias("v")).mapInPandas(run, "dim int, part long, n long")
        return parts.groupBy("dim", "part").agg(F.sum("n").alias("n"))

    def at(found: DataFrame, place: dict[int, int]) -> dict[int, tuple[int, int]]:
        """For each dimension the part that holds the value at its place, and the place within the part."""
        below = F.sum("n").over(Window.partitionBy("dim").orderBy("part"))
        wanted = spark.createDataFrame(list(place.items()), "dim int, place long")
        rows = found.withColumn("upto", below).join(F.broadcast(wanted), "dim").where("upto > place and upto - n <= place")  # a row for each dimension
        return {r.dim: (r.part, r.place - (r.upto - r.n)) for r in rows.collect()}

    upper = at(counts(None), {d: size.n // 2 for d in range(size.hi)})
    middle = np.array([upper[d][0] for d in range(size.hi)], np.uint32)
    lower = at(counts(middle), {d: upper[d][1] for d in range(size.hi)})
    return spark.createDataFrame([(d, _value((upper[d][0] << 16) | lower[d][0])) for d in range(size.hi)], "dim int, median float")


def pooled(vectors: DataFrame, by: list[str], vector: str = "embedding", weight: str | None = None, dim: int | None = None, normalize: bool = True) -> DataFrame:
    """(by, pooled): the mean, or weighted mean, of the vectors of a group, at unit length.

    Unweighted: vectors of another dimension than `dim` are skipped, and a single vector is returned as it is.
    Weighted: they, and weights that are negative or not finite, are an error; a total weight of 0 gives zeros.
    """
    rows = vectors
    if weight is None:
        if dim:
            rows = rows.where(F.size(vector) == dim)
        w = F.lit(1.0)
    else:
        ok = (F.col(weight) >= 0) & (F.col(weight) < float("inf")) & ((F.size(vector) == dim) if dim else F.lit(True))
        w = F.when(ok, F.col(weight)).otherwise(F.raise_error(F.lit("weights must be finite and not negative, and dimensions equal")).cast("double"))
    d = dimensions(rows, by, vector, w).groupBy(*by, "dim").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"))
    mean = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0)
    v = d.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", mean.alias("m")))), lambda p: p["m"]).alias("m"), F.max("n").alias("n"))
    if not normalize:
        return v.select(*by, F.col("m").alias("pooled"))
    length = norm(F.col("m"))
    unit = F.transform("m", lambda x: F.when(length > 0, x / length).otherwise(x))
    keep = F.col("n") == 1 if weight is None else F.lit(False)
    return v.select(*by, F.when(keep, F.col("m")).otherwise(unit).alias("pooled"))


def centroid(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """The plain mean of each group; null if its vectors differ in length."""
    lengths = vectors.groupBy(*by).agg((F.min(F.size(vector)) == F.max(F.size(vector))).alias("ok"))
    return pooled(vectors, by, vector, normalize=False).join(lengths, by).select(*by, F.when(F.col("ok"), F.col("pooled")).alias("centroid"))


def average_similarity(vectors: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """The mean cosine over all pairs of each group; 1 for fewer than two vectors.

    From sums of unit vectors, (|sum|^2 - sum of squared lengths) / (n (n - 1)), in one pass and not over pairs;
    of different lengths, or zero, a vector has cosine 0 with all others, as in the pairwise form.
    """
    unit = vectors.select(*by, vector, norm(F.col(vector)).alias("len"))
    d = unit.where("len > 0").select(*by, F.size(vector).alias("size"), F.posexplode(F.transform(vector, lambda x: x.cast("double") / F.col("len"))).alias("dim", "x"))
    squares = d.groupBy(*by, "size", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).groupBy(*by).agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("twice"))
    n = vectors.groupBy(*by).agg(F.count("*").alias("n"))
    return n.join(squares, by, "left").select(*by, F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce("twice", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def group_max_pool(queries: DataFrame, vectors: DataFrame, k: int, group: str = "label", query_id: str = "query_id") -> DataFrame:
    """The k groups with the highest dot product of any member, for each query; ties by group. Only a block's best of each group is shuffled."""
    from .vectors import DIGITS, in_blocks, matrix

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        parts = []
        names, of = np.unique(v[group].to_numpy(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(len(names)))
        for dim, some in q.groupby(q.q.map(lambda x: len(x) if x is not None else 0)):
            s = np.round(matrix(some.q.tolist(), dim) @ matrix(v.embedding.tolist(), dim).T, DIGITS) + 0.0
            best = np.maximum.reduceat(s[:, order], first, axis=1)
            parts.append(pd.DataFrame({query_id: np.repeat(some[query_id].to_numpy(), len(names)), group: np.tile(names, len(some)), "score": best.ravel()}))
        return pd.concat(parts)

    kinds = dict(queries.dtypes) | dict(vectors.dtypes)
    rows = vectors.where(F.col(group).isNotNull()).select(group, "embedding")
    best = in_blocks(queries.select(query_id, F.col("v").alias("q")), rows, run, f"{query_id} {kinds[query_id]}, {group} {kinds[group]}, score double")
    best = best.groupBy(query_id, group).agg(F.max("score").alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), group)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("chunk_index", F.lit(-1))


def min_max(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Values scaled to 0..1 within their group; 0.5 for fewer than two values and for a spread under 1e-10."""
    spread = [F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__n")]
    if by:
        w = Window.partitionBy(*by)
        rows = rows.select("*", *(c.over(w).alias(n) for c, n in zip((F.min(value), F.max(value), F.count(value)), ("__lo", "__hi", "__n"))))
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(*spread)))  # one row
    lo, hi = F.col("__lo"), F.col("__hi")
    flat = (F.col("__n") < 2) | (hi - lo < 1e-10)
    return rows.withColumn("scaled", F.when(flat, 0.5).otherwise((F.col(value) - lo) / F.when(flat, 1.0).otherwise(hi - lo))).drop("__lo", "__hi", "__n")


LEAST_SAMPLES = 20


def percentiles(scores: DataFrame, cohort: DataFrame, score: str = "score", sample: str = "sample") -> DataFrame:
    """Where each score lies in a reference cohort: (number of samples <= score - 1) / (n - 1), within 0..1.

    The cohort's finite samples must be 20 at least. Scores and samples are merged in one sort, not compared pair by pair.
    """
    good = cohort.where(~F.isnan(sample) & (F.abs(sample) < float("inf"))).select(F.col(sample).cast("double").alias("v"))
    n = good.count()
    if n < LEAST_SAMPLES:
        raise ValueError(f"a reference cohort needs {LEAST_SAMPLES} samples, not {n}")
    steps = good.groupBy("v").agg(F.count("*").alias("c"))
    marks = scores.select(F.col(score).cast("double").alias("v")).distinct()
    merged = steps.select("v", "c", F.lit(0).alias("o")).union(marks.select("v", F.lit(0).cast("long"), F.lit(1)))
    # ranges of values first, so that the running sum isn't one task's work
    blocks = merged.repartitionByRange("v").withColumn("blk", F.spark_partition_id())
    before = blocks.groupBy("blk").agg(F.sum("c").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = blocks.join(F.broadcast(before.select("blk", "base")), "blk").withColumn("below", F.col("base") + F.sum("c").over(Window.partitionBy("blk").orderBy("v", "o")))
    rank = at.where("o = 1").select(F.col("v").alias("__v"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("below") - 1) / (n - 1))).alias("percentile"))
    return scores.join(rank, F.col(score).cast("double") == F.col("__v")).drop("__v")


def against_cohort(hits: DataFrame, cohort: DataFrame, by: str = "query_id", id_column: str = "id", sample: str = "sample") -> DataFrame:
    """Ranked hits with their percentiles in the cohort as scores, ranked anew; equal percentiles keep the order of the scores they had."""
    found = percentiles(hits, cohort, "score", sample)
    w = Window.partitionBy(by).orderBy(F.desc("percentile"), F.desc("score"), id_column)
    return found.withColumn("rank", F.row_number().over(w)).drop("score").withColumnRenamed("percentile", "score")
