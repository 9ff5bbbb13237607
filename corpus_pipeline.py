"""The corpus pipeline: documents in, packed training windows out.

Each stage works on all that the one before it kept and is written before the next
reads it. All but the last return the columns of documents, whatever these are; further columns, of any name, come along.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, linededup, neardup, packing, textops, toxicity
from tessera.llm.catalog import benchmark, labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; the model is fitted on the labelled ones of the whole table.

    Null and empty texts and rows without a doc_id: the former stay, the latter are judged by their texts. Repeated rows share
    a fate. Very long texts are scored whole. Without labels of both kinds, or documents, nothing goes.
    """
    whole = textops.documents(spark, sf_dir)
    return toxicity.without_toxic(spark, docs, toxicity.train(spark, whole, labels(spark, sf_dir)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents of which no word is left; n_chars follows the text.

    Null and empty texts, rows without a doc_id and lines of fewer than three different words stay as they are. Rows that repeat
    a doc_id are one document. Of equal lines the one with the lowest doc_id and line number stays.
    """
    return linededup.without_repeated_lines(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near-duplicates stays.

    Texts without words and rows without a doc_id stay; rows that repeat a doc_id share a fate.
    """
    return neardup.deduplicated(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts and rows without a doc_id stay; rows that repeat a doc_id share a fate; without benchmark items nothing goes.
    """
    return decontam.decontaminated(spark, docs, benchmark(spark, sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of what is left, a row for each piece of each document.

    Texts without tokens are pieces of length 0; rows without a doc_id and repeated rows are packed like all others; long texts are
    cut into pieces; no documents give no windows.
    """
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't train dictionaries or count tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.

    What the stages before it keep is written to the shared folder, a table for each, which goes once the next stage is written;
    packing reads its documents once, before it returns.
    """
    folder = posixpath.join(textops.shared_folder(spark), f"pipeline-{uuid.uuid4()}")
    docs, read = textops.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        out = posixpath.join(folder, name.replace(" ", "-"))
        with textops.temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        if read:
            textops.remove(spark, read)
        docs, read = spark.read.parquet(out), out
    windows = STAGES[-1][1](spark, docs, sf_dir)
    textops.remove(spark, folder)
    return windows
