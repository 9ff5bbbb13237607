"""Catalogue: chunking, the store, ingestion and the facade."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine, Options
from ..functions.text import hashing_vectors
from ..functions.tokenizer import Tokenizer
from ..operators import chunking, search
from ..operators.vectors import small
from ..sources.shared import shared_folder
from ..sources.store import ChunkStore
from .catalog_text import BM25_CTE
from .tables import bm25_run, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return posixpath.join(shared_folder(spark), f"store-{uuid.uuid4()}")


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """The conversations as markdown, a section for each turn."""
    t = table(spark, d, "conversations")
    part = F.concat(F.lit("## "), F.upper("role"), F.lit("\n\n"), "text")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"])
    return t.groupBy("conv_id").agg(F.array_join(turns, "\n\n").alias("text")).withColumnRenamed("conv_id", "doc_id")


def _chunks(strategy: str, size: int, overlap: int, source, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = chunking.chunk(source(spark, d), strategy, size, overlap, **options)
        return c.select("doc_id", "id", "text", "char_count", "word_count", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.array_join("path", " > ").alias("path"), "content_hash")

    return run


_OPTIONS = {"token_chunks": {"tokenizer": Tokenizer()}, "semantic_chunks": {"embed": hashing_vectors}}
for _name, _args in {
    "sentence_chunks": ("sentence", 600, 60), "smart_chunks": ("smart", 220, 40), "word_chunks": ("word", 400, 40), "paragraph_chunks": ("paragraph", 800, 0),
    "token_chunks": ("token", 128, 16), "hard_cut_overlap_chunks": ("hard_cut", 500, 50), "optimal_chunks": ("optimal", 2000, 0), "semantic_chunks": ("semantic", 1200, 0),
}.items():
    QUERIES[_name] = _chunks(*_args, lambda s, d: table(s, d, "documents").select("doc_id", "text"), **_OPTIONS.get(_name, {}))
for _name, _args in {"markdown_chunks": ("markdown", 700, 0), "heading_chunks": ("heading", 700, 0)}.items():
    QUERIES[_name] = _chunks(*_args, markdown)


@query("""SELECT doc_id, CASE WHEN length(text) <= 3000 THEN text ELSE text[1:2000] || e'\\n\\n[… middle …]\\n' || substr(text, floor(length(text) / 2 - 250)::int + 1, 500) || e'\\n\\n[… end …]\\n' || substr(text, length(text) - 499, 500) END AS sample FROM documents""")
def optimal_sample(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.strategic_sample("text", 3000).alias("sample"))


@query(f"""WITH {BM25_CTE}, b AS (SELECT query_id, rank, '[' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || '] ' || doc_id || chr(10) || text AS block, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM run JOIN documents USING (doc_id) WHERE text <> ''),
u AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_blocks FROM u WHERE used <= 1500 GROUP BY 1""")
def context_block(spark, d):
    hits = table(spark, d, "documents").join(small(bm25_run(spark, d)), "doc_id")
    hits = hits.select("query_id", "rank", F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("content"))
    return search.context(hits, 1500, F.size(F.split(F.trim("content"), r"\s+")))


def _rows(spark, d, odd: bool, mark: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("doc_id") % 2 == 1) if odd else table(spark, d, "documents")
    return docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("document_id"), F.lit(mark).alias("filename"), F.col("text").alias("content"))


@query("SELECT 'c' || doc_id AS id, source AS document_id, CASE WHEN doc_id % 2 = 1 THEN 'new' ELSE 'old' END AS filename FROM documents")
def store_upsert(spark, d):
    s = ChunkStore(spark, _folder(spark))
    s.upsert(_rows(spark, d, False, "old"), "id")
    s.upsert(_rows(spark, d, True, "new"), "id")
    return s.read().select("id", "document_id", "filename")


@query("SELECT 'c' || doc_id AS id, source AS document_id, CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END AS filename FROM documents WHERE source <> 'src2' AND (source <> 'src1' OR doc_id % 2 = 1)")
def store_replace(spark, d):
    """Two documents are replaced, one by some of its rows and one by none."""
    s = ChunkStore(spark, _folder(spark))
    s.upsert(_rows(spark, d, False, "old"), "id")
    s.replace_documents(spark.createDataFrame([("src1",), ("src2",)], "document_id string"), _rows(spark, d, True, "new").where("document_id = 'src1'"))
    return s.read().select("id", "document_id", "filename")


@query("SELECT 'c' || doc_id AS id, source AS document_id FROM documents WHERE source <> 'src3'")
def store_delete(spark, d):
    s = ChunkStore(spark, _folder(spark))
    s.upsert(_rows(spark, d, False, "old"), "id")
    s.delete_document("src3")
    return s.read().select("id", "document_id")


def _engine(spark, d) -> tuple[Engine, DataFrame]:
    e = Engine(spark, _folder(spark), dim=64, strategy="sentence", size=1200)
    e.ingest(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.col("source"), F.lit(".txt")).alias("title"), "text").dropDuplicates(["id"]))
    return e, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query()
def engine_search(spark, d):
    e, q = _engine(spark, d)
    return e.search(q, Options(top_k=5, candidates=50)).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query()
def engine_search_rrf_mmr(spark, d):
    e, q = _engine(spark, d)
    return e.search(q, Options(top_k=5, candidates=30, rrf=True, mmr=0.7)).select("query_id", "rank", "id", F.round("score", 6).alias("score"))
