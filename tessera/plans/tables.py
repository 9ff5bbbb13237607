"""The tables that the catalogue's queries read, in the shapes that operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical
from ..operators.vectors import small
from ..sources.shared import shared_folder

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and floats rounded, so that results of two engines can be compared."""
    return df.select(*(F.round(F.col(c).cast("double"), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("chunk_index"), F.col("embedding").alias("v"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a query."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def bm25_run(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return two_lanes(spark, sf_dir, k, ("bm25",)).select("query_id", "doc_id", "score", "rank")


def two_lanes(spark: SparkSession, sf_dir: str, k: int = 10, sources: tuple[str, ...] = ("bm25", "keyword")) -> DataFrame:
    """(query_id, source, doc_id, score, rank) of the benchmark's items over the documents."""
    return lexical.lanes(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k, sources=sources)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant to a benchmark item that it contains word for word."""
    shared_folder(spark)
    return contained(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, sf_dir, "documents")).checkpoint()  # few rows, which measures read several times


def contained(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance, topic) of the documents whose text contains an item's (query_id, text), letter by letter.

    Only an item's inner words must be whole words of such a document, as the first and the last may be parts of longer ones; so pairs meet
    by the longest inner word, and only items without one are held against every text.
    """
    inner = F.slice(F.split("item", r"\s+"), 2, F.greatest(F.size(F.split("item", r"\s+")) - 2, F.lit(0)))
    i = items.select("query_id", F.col("text").alias("item")).where("item is not null").select("query_id", "item", F.array_sort(inner, lambda a, b: F.char_length(b) - F.char_length(a)).alias("w"))
    i = i.select("query_id", "item", F.get("w", F.lit(0)).alias("w"))
    d = docs.select("doc_id", "text", F.col("source").alias("topic"))
    words = d.select("doc_id", "text", "topic", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w"))
    found = words.join(small(i.where("w is not null")), "w").where(F.col("text").contains(F.col("item")))
    short = d.crossJoin(small(i.where("w is null"))).where(F.col("text").contains(F.col("item")))
    return found.select("query_id", "doc_id", "topic").union(short.select("query_id", "doc_id", "topic")).distinct().select("query_id", "doc_id", F.lit(1.0).alias("relevance"), "topic")
