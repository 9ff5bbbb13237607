"""Resumable ingestion: a directory as a stream, decoded and mapped row by row, written batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import MOST_BYTES
from ..sources.shared import shared_folder
from ..sources.store import ChunkStore

PAGE = 64


@dataclass
class Report:
    """Counts over the batches of a run."""

    read: int = 0
    written: int = 0
    skipped: int = 0
    batches: int = 0
    errors: list[str] = field(default_factory=list)


def directory(spark: SparkSession, path: str, page: int = PAGE, glob: str | None = None) -> DataFrame:
    """The files of a directory tree as a stream of pages; what was read is kept in the query's checkpoint."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("maxFilesPerTrigger", str(page)).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decoded(files: DataFrame, decode: Callable[[str, bytes], list[dict]], schema: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, error, row struct): the records of each file, or why it couldn't be decoded. A file gives any number of records."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, content, length in zip(pdf.path, pdf.content, pdf.length):
                try:
                    if length > most_bytes:
                        raise ValueError("too large")
                    out += [(path, None, r) for r in decode(path, bytes(content))]
                except Exception as e:  # noqa: BLE001 - a record that can't be decoded is counted and skipped
                    out.append((path, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(out, columns=["path", "error", "row"])

    return files.select("path", "content", "length").mapInPandas(run, f"path string, error string, row struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>")


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> Report:
    """Everything that is there now, batch by batch; resumes after the last batch that the sink took. A failing sink ends the run.

    The sink may see a batch again after a failure, so it should replace rows by id.
    """
    report = Report()

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ok", F.col("error").isNull())
        shared_folder(batch.sparkSession)
        rows = rows.checkpoint()  # decoded once for the counts and the sink
        counts = rows.agg(F.count_distinct("path").alias("read"), F.count_if("ok").alias("written"), F.count_if(~F.col("ok")).alias("skipped"), F.slice(F.collect_set("error"), 1, 5).alias("errors")).first()
        sink(rows.where("ok").select("row.*"), number)
        report.read, report.written, report.skipped = report.read + counts.read, report.written + counts.written, report.skipped + counts.skipped
        report.errors = (report.errors + counts.errors)[:5]
        report.batches += 1

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return report


def index_sink(store: ChunkStore, identity: str = "") -> Callable[[DataFrame, int], None]:
    """A sink that upserts rows into a store; rows without an identity get this one, another one is an error before any write."""

    def write(rows: DataFrame, number: int) -> None:
        rows = rows.where(F.col("id").isNotNull())
        named = F.coalesce("index_identity", F.lit("")) if "index_identity" in rows.columns else F.lit("")
        if identity and rows.where((named != "") & (named != identity)).limit(1).count():
            raise ValueError("rows of another identity")
        # of rows with one id the last as they were decoded stays; the batch is written, so that its order is fixed
        store.upsert(rows.withColumn("index_identity", F.when(named == "", identity).otherwise(named)).withColumn("__at", F.monotonically_increasing_id()), "__at")

    return write
