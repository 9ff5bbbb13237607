"""The facade: ingest documents, search them, explain the results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import hashing_embedding
from .operators import chunking, lexical, scoring, search
from .operators.vectors import small
from .sources.filters import checked, matches
from .sources.shared import shared_folder
from .sources.store import ChunkStore


@dataclass(frozen=True)
class Options:
    """How a search ranks. None for top_k and candidates means all; top_k of 0 or less means none."""

    top_k: int | None = 10
    candidates: int | None = None
    weights: scoring.Weights = scoring.DEFAULT
    adaptive: bool = False
    filters: dict | None = None
    rrf: bool = False
    rrf_k: float = lexical.RRF_K
    reranker: Callable | None = None
    mmr: float | None = None
    explain: bool = False


class Engine:
    """Search over a chunk store. Queries come as a DataFrame (query_id, query); a single one is a batch of one."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column] | None = None, dim: int = 256, identity: str = "", strategy: str = "smart", size: int = chunking.DEFAULT_SIZE, overlap: int = chunking.DEFAULT_OVERLAP):
        self.spark, self.store = spark, ChunkStore(spark, folder)
        self.embed = embed or (lambda c: hashing_embedding(c, dim))
        self.identity = identity or f"hashing:{dim}"
        self.strategy, self.size, self.overlap = strategy, size, overlap

    def ingest(self, docs: DataFrame) -> int:
        """Chunks of the documents (id, title, text) replace what the store has of them; returns how many."""
        rows = chunking.result_rows(docs, self.strategy, self.size, self.overlap)
        rows = rows.withColumn("embedding", self.embed(F.col("content")).cast("array<double>")).withColumn("metadata", F.to_json("metadata")).withColumn("index_identity", F.lit(self.identity))
        shared_folder(self.spark)
        self.store.replace_documents(docs.select(F.col("id").alias("document_id")), rows)
        return self.store.read().join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi").count()

    def _rows(self, filters: dict | None) -> DataFrame:
        rows = self.store.read().withColumn("metadata", F.parse_json(F.coalesce("metadata", F.lit("{}"))))
        return (rows.where(matches(checked(filters))) if filters else rows).drop("metadata")

    def _sides(self, queries: DataFrame, filters: dict | None) -> tuple[DataFrame, DataFrame]:
        q = queries.where(F.coalesce(F.trim("query"), F.lit("")) != "").select("query_id", "query", self.embed(F.col("query")).cast("array<double>").alias("q"))
        return q, self._rows(filters).withColumnRenamed("embedding", "v")

    def search(self, queries: DataFrame, options: Options = Options()) -> DataFrame:
        """(query_id, rank, id, document_id, filename, content, score[, explain, rerank, mmr]) of the best chunks; blank queries have no rows.

        With options.explain: signals and ranks of the lanes; the rank before and after the reranker; what diversification weighed.

        Candidates are cut by the default weights; what survives is calibrated anew and scored by the options' weights; then
        comes the reranker, then diversification or the cut to top_k.
        """
        sides = self._sides(queries, options.filters)
        found = self._fused(*sides, options) if options.rrf else self._hybrid(*sides, options)
        k = options.top_k
        found = found.select("query_id", "query", "id", "score", *(["explain"] if options.explain else []), F.col("place").alias("rank"))
        if k is not None and options.mmr is None and not options.reranker:
            found = found.where(F.col("rank") <= max(k, 0))
        if options.candidates and options.candidates > 0:
            found = small(found.checkpoint())  # few rows, to which the texts come
        found = found.join(self.store.read().select("id", "document_id", "filename", "content", F.col("embedding").alias("v")), "id")
        if options.reranker:
            found = search.rerank(found, options.reranker).drop("rank")
            if options.explain:
                found = found.withColumn("rerank", F.struct(F.col("previous_rank").alias("before"), F.col("rerank_rank").alias("after"), F.col("score").alias("score")))
            found = found.drop("previous_rank").withColumnRenamed("rerank_rank", "rank")
        if options.mmr is not None:
            picked = search.mmr(found.withColumnRenamed("id", "doc_id"), k if k is not None else 1 << 30, options.mmr).select("query_id", F.col("doc_id").alias("id"), F.col("mmr_rank").alias("__r"), *([F.struct("relevance", "similarity", "value").alias("mmr")] if options.explain else []))
            found = found.join(picked, ["query_id", "id"]).drop("rank").withColumnRenamed("__r", "rank")
        elif k is not None:
            found = found.where(F.col("rank") <= max(k, 0))
        return found.drop("v", "query")

    def _hybrid(self, queries: DataFrame, rows: DataFrame, o: Options) -> DataFrame:
        # what is ranked are ids and signals; texts come back for the results only
        pairs = scoring.best_pairs(queries, rows, o.candidates).drop("lane", "score", "hybrid_rank") if o.candidates and o.candidates > 0 else scoring.signals(queries, rows)
        return scoring.hybrid(pairs.join(queries.select("query_id", "query"), "query_id"), o.weights, o.adaptive, trace=o.explain).withColumn("place", F.col("hybrid_rank"))

    def _fused(self, queries: DataFrame, rows: DataFrame, o: Options) -> DataFrame:
        """Two lanes, vectors only and text only, fused by rank; scores are scaled so that a first place everywhere is 1."""
        weights = {"vector": scoring.Weights(1, 0, 0), "text": scoring.Weights(0, 1, 0)}
        if o.candidates and o.candidates > 0:
            both = scoring.best_pairs(queries, rows, o.candidates, weights).select("query_id", "id", F.col("lane").alias("source"), F.col("hybrid_rank").alias("rank"))
        else:
            pairs = scoring.signals(queries, rows).withColumn("query", F.lit(""))
            lanes = [scoring.hybrid(pairs, w).select("query_id", "id", F.lit(name).alias("source"), F.col("hybrid_rank").alias("rank")) for name, w in weights.items()]
            both = lanes[0].union(lanes[1])
        n = both.groupBy("query_id").agg(F.count_distinct("source").alias("n"))
        k = o.rrf_k if o.rrf_k > 0 else lexical.RRF_K
        fused = lexical.rrf(both, k).join(n, "query_id").select("query_id", "id", (F.col("score") * (k + 1) / F.col("n")).alias("score"), F.col("rank").alias("place"))
        if o.explain:
            at = both.groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("source", "rank"))).alias("explain"))
            fused = fused.join(at, ["query_id", "id"])
        return fused.join(queries.select("query_id", "query"), "query_id")

    def context(self, results: DataFrame, budget: int) -> DataFrame:
        """Text blocks for each query from its results, within a budget of words."""
        return search.context(results, budget, F.size(F.split(F.trim("block"), r"\s+")))

    def reset(self) -> None:
        self.store.reset()


def ranked(results: DataFrame) -> DataFrame:
    """Final ranks without gaps."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
