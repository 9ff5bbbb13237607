"""Diversification, external reranking and rendering of context over bounded candidate lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _select(rel: np.ndarray, vectors: list, k: int, lam: float) -> list[tuple[int, float, float, float]]:
    """(index, relevance, worst similarity, value) of each pick."""
    dim = max((len(v) for v in vectors if v is not None), default=0)
    x = np.zeros((len(rel), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim and dim:
            x[i] = v
    norm = np.sqrt((x * x).sum(1))
    x = x / np.where(norm > 0, norm, 1)[:, None]
    penalty = np.zeros(len(rel))
    left = ~np.isnan(rel)
    out = []
    for _ in range(min(k, int(left.sum()))):
        value = np.where(left, lam * rel - (1 - lam) * penalty, -np.inf)
        i = int(np.argmax(np.round(value, 12)))
        out.append((i, float(rel[i]), float(penalty[i]), float(value[i])))
        left[i] = False
        penalty = np.maximum(penalty, x @ x[i])
    return out


def mmr(candidates: DataFrame, k: int, lam: float = 0.5, by: str = "query_id", id_column: str = "doc_id", score: str = "score", vector: str = "v") -> DataFrame:
    """Maximal marginal relevance: (by, id, mmr_rank, relevance, similarity, value) of k picks for each query.

    Each pick is lam * relevance - (1 - lam) * (highest cosine to what was picked, 0 at least); lam is held within 0..1; the
    first of equal ones wins; NaN scores are skipped; a missing vector costs nothing. Sequential within a query, so the
    candidates of a query, which should be a bounded list, are one task's work; queries run in parallel.
    """
    lam = min(1.0, max(0.0, lam))
    types = dict(candidates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id_column], ascending=[False, True]).reset_index(drop=True)
        picks = _select(pdf[score].to_numpy(float), pdf[vector].tolist(), max(k, 0), lam)
        rows = [(pdf[by][i], pdf[id_column][i], n + 1, r, s, v) for n, (i, r, s, v) in enumerate(picks)]
        return pd.DataFrame(rows, columns=[by, id_column, "mmr_rank", "relevance", "similarity", "value"])

    schema = f"{by} {types[by]}, {id_column} {types[id_column]}, mmr_rank int, relevance double, similarity double, value double"
    return candidates.select(by, id_column, F.col(score).cast("double").alias(score), vector).groupBy(by).applyInPandas(run, schema)


def rerank(candidates: DataFrame, reranker: Callable[[str, list[str]], list[float]], by: str = "query_id", query: str = "query", content: str = "content", rank: str = "rank") -> DataFrame:
    """Scores by an external model, one call for each query with its candidates in order; they replace `score`.

    The model must give as many scores as candidates, all within 0..1; equal scores keep their order.
    """
    fields = [f for f in candidates.schema.fields if f.name not in ("score", "rerank_rank", "previous_rank")]
    names = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank, kind="stable").reset_index(drop=True)
        got = list(reranker(pdf[query].iloc[0], pdf[content].tolist()))
        if len(got) != len(pdf) or not all(np.isfinite(g) and 0 <= g <= 1 for g in got):
            raise ValueError("a reranker must give a finite score within 0..1 for each candidate")
        pdf["score"], pdf["previous_rank"] = np.array(got, float), pdf[rank].astype("int32")
        pdf = pdf.sort_values("score", ascending=False, kind="stable")
        pdf["rerank_rank"] = np.arange(1, len(pdf) + 1, dtype=np.int32)
        return pdf[[*names, "score", "previous_rank", "rerank_rank"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, previous_rank int, rerank_rank int"
    return candidates.select(*names).groupBy(by).applyInPandas(run, schema)


def context(results: DataFrame, budget: int, tokens: Column, by: str = "query_id", content: str = "content", rank: str = "rank", header: str = "[%d] %s", name: str = "filename") -> DataFrame:
    """(by, context, n_blocks): blocks of a header and the content, in rank order, as many whole ones as the budget holds.

    `tokens` counts one block and is additive. Empty contents are skipped. In the header, %d is the number of the block, %s the
    name and %% a percent sign.
    """
    rows = results.where(F.coalesce(F.col(content), F.lit("")) != "").withColumn("block_no", F.row_number().over(Window.partitionBy(by).orderBy(rank)))
    head = F.replace(F.replace(F.replace(F.replace(F.lit(header), F.lit("%%"), F.lit("\0")), F.lit("%d"), F.col("block_no").cast("string")), F.lit("%s"), F.coalesce(F.col(name), F.lit(""))), F.lit("\0"), F.lit("%"))
    rows = rows.withColumn("block", F.concat(head, F.lit("\n"), F.col(content))).withColumn("n", tokens)
    used = rows.withColumn("used", F.sum("n").over(Window.partitionBy(by).orderBy("block_no"))).where(F.col("used") <= budget)
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "block"))), lambda b: b["block"])
    return used.groupBy(by).agg(F.array_join(blocks, "\n\n").alias("context"), F.count("*").alias("n_blocks"))


def attach(results: DataFrame, embeddings: DataFrame, position: str = "position", vector: str = "v") -> DataFrame:
    """Results with the embeddings of the same positions; an error unless both sides have the same positions, each once."""
    a, b = results.groupBy(position).agg(F.count("*").alias("n")), embeddings.groupBy(position).agg(F.count("*").alias("m"))
    bad = a.join(b, position, "full").where("n is null or m is null or n > 1 or m > 1")
    wrong = [r[position] for r in bad.orderBy(position).limit(5).collect()]
    if wrong:
        raise ValueError(f"results and embeddings don't go together at positions {wrong}")
    return results.drop(vector).join(embeddings.select(position, F.col(vector)), position)


def embedded(results: DataFrame, embed: Callable[[Column], Column], content: str = "content", vector: str = "v") -> DataFrame:
    """Results with the embeddings of their contents; a missing content is an error."""
    text = F.when(F.col(content).isNotNull(), F.col(content)).otherwise(F.raise_error(F.lit("a result has no content")).cast("string"))
    return results.withColumn(vector, embed(text).cast("array<double>"))


def lexical_results(queries: DataFrame, rows: DataFrame, k: int, explain: bool = False) -> DataFrame:
    """The k best rows (id, content, ...) of a store by BM25 for each query (query_id, query), with scores and ranks, and on demand each shared term's part.

    explain: an array of (term, tf, df, idf, part), by term, whose parts sum up to the score.
    """
    from . import lexical

    q = queries.select(F.col("query_id").alias("item_id"), F.col("query").alias("text"))
    d = rows.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    terms = lexical.bm25_terms(q, d)
    total = terms.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), *([F.array_sort(F.collect_list(F.struct("term", "tf", "df", "idf", "part"))).alias("explain")] if explain else []))
    best = lexical.top_k(total.withColumn("score", F.round("score", 12)), k)
    return best.withColumnRenamed("doc_id", "id").join(rows, "id")
