"""Queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, gif, langid, linededup, neardup, packing, quality, secrets, tokens, toxicity
from .textops import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.removed_lines(spark, documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(spark, docs, secrets.train(spark, docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, documents(spark, sf_dir), benchmark(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(spark, docs, toxicity.train(spark, docs, labels(spark, sf_dir)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(spark, documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(spark, documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir))


def op8_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images, so each vector of `embeddings` is drawn as one, which the operator then decodes."""
    return gif.frames(gif.thumbnails(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = documents(spark, sf_dir), labels(spark, sf_dir)
    return quality.quality(spark, docs, known, spark.read.parquet(f"{sf_dir}/pages.parquet"), quality.train(spark, docs, known))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(spark, docs, langid.train(spark, docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_secrets, op3_decontamination, op4_toxicity, op5_token_counts, op6_near_duplicates, op7_packing, op8_gif_frames, op9_quality, op10_language)}
#: Lines in SQL: the same prefix filter over document frequencies, so that it, too, is exact without comparing all pairs.
LINES_SQL = r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM t),
s AS (SELECT doc_id, line_no::int AS line_no, list_sort(list_distinct(regexp_extract_all(lower(line), '[\p{L}\p{N}\p{M}]+'))) AS w FROM l),
k AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(line_no) OVER o AS fl FROM s WHERE len(w) >= 3 WINDOW o AS (PARTITION BY w ORDER BY doc_id, line_no)),
r AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS id, doc_id, line_no, w, len(w) AS n FROM k WHERE doc_id = fd AND line_no = fl),
tok AS (SELECT id, n, unnest(w) AS term FROM r), df AS (SELECT term, count(*) AS df FROM tok GROUP BY 1),
p AS (SELECT id, n, term FROM tok JOIN df USING (term) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, term) <= n - (17 * n + 19) // 20 + 1),
c AS (SELECT DISTINCT x.id AS later, y.id AS earlier FROM p x JOIN p y ON x.term = y.term AND y.id < x.id AND y.n * 20 >= x.n * 17 AND x.n * 20 >= y.n * 17),
v AS (SELECT a.doc_id, a.line_no, b.doc_id AS kept_doc_id, b.line_no AS kept_line_no, len(list_intersect(a.w, b.w)) AS i, a.n + b.n AS m, later, earlier FROM c JOIN r a ON a.id = later JOIN r b ON b.id = earlier)
SELECT doc_id, line_no, fd AS kept_doc_id, fl AS kept_line_no, 1.0::double AS similarity FROM k WHERE NOT (doc_id = fd AND line_no = fl)
UNION ALL SELECT doc_id, line_no, kept_doc_id, kept_line_no, i / (m - i) AS similarity FROM v WHERE i * 20 >= 17 * (m - i) QUALIFY row_number() OVER (PARTITION BY later ORDER BY earlier) = 1"""
ORACLES: dict[str, str] = {"op1_line_dedup": LINES_SQL}
