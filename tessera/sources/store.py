"""A chunk store in Parquet: rows in buckets by document, versions by a log whose entries are made once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_folder

SCHEMA = "id string, document_id string, filename string, content string, metadata string, embedding array<double>, index_identity string, recency_score double, importance_score double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class Conflict(RuntimeError):
    """Another writer committed since this one had read the store; nothing was changed, and the write can be tried again."""


class ChunkStore:
    """Rows by id under a folder that all executors share.

    Rows lie in buckets by a hash of their document's id; a write makes new files only for the buckets that it touches. A version is
    an entry of the log, renamed into place where there is none with its number yet: readers see the old rows or
    the new ones, a failed write leaves the old, and of two writers one gets a Conflict. The identity and dimension of the vectors
    are latched by the first row that has one, survive deletes, and are cleared by reset() only.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2, buckets: int = 64):
        self.spark, self.folder, self.keep, self.buckets = spark, folder.rstrip("/"), keep, buckets
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[int]:
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted(int(n[4:]) for n in names if n.startswith("log-"))

    def _entry(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/log-{version:012d}").first()[0])

    def _state(self) -> dict:
        log = self._log()
        return self._entry(log[-1]) if log else {"version": 0, "buckets": self.buckets, "files": {}, "identity": None, "dim": None}

    def _commit(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        temporary = self._path(f"{self.folder}/new-{uuid.uuid4()}")
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        target = self._path(f"{self.folder}/log-{state['version']:012d}")
        try:
            context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(target), self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(target):
                raise Conflict(f"version {state['version']} was written meanwhile") from e
            raise
        self._clean(state["version"])

    def _clean(self, version: int) -> None:
        """Entries but the last few go, and files that only they had."""
        log = [v for v in self._log() if v <= version]
        stay = {f for v in log[-self.keep :] for f in self._entry(v)["files"].values()}
        for v in log[: -self.keep]:
            for f in set(self._entry(v)["files"].values()) - stay:
                self._fs.delete(self._path(f"{self.folder}/{f}"), True)
            self._fs.delete(self._path(f"{self.folder}/log-{v:012d}"), False)

    def _read(self, state: dict, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{f}" for b, f in sorted(state["files"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        return self._read(self._state())

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("document_id", F.lit(""))), F.lit(state["buckets"])).cast("int")

    def _touched(self, rows: DataFrame, state: dict) -> set[int]:
        return {r.b for r in rows.select(self._bucket(state).alias("b")).distinct().collect()}  # a number for each bucket, at most

    def _complete(self, rows: DataFrame) -> DataFrame:
        types = dict(f.split(" ", 1) for f in SCHEMA.split(", "))
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in COLUMNS))

    def _checked(self, rows: DataFrame, state: dict) -> dict:
        """The state with its latch, or an error before anything is written."""
        size, named = F.size("embedding"), F.coalesce("index_identity", F.lit(""))
        seen = rows.agg(
            F.min(F.when(size > 0, size)).alias("lo"), F.max(F.when(size > 0, size)).alias("hi"), F.count_if(F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"),
            F.min(F.when(named != "", named)).alias("a"), F.max(F.when(named != "", named)).alias("b"), F.count_if(F.coalesce(F.trim("id"), F.lit("")) == "").alias("no_id"),
        ).first()
        if seen.no_id:
            raise ValueError("rows need an id")
        if seen.bad:
            raise ValueError("embeddings must be finite")
        if seen.lo != seen.hi or (seen.lo and state["dim"] and seen.lo != state["dim"]):
            raise ValueError(f"dimension {seen.lo}..{seen.hi} differs from {state['dim'] or seen.lo}")
        if seen.a != seen.b or (seen.a and state["identity"] and seen.a != state["identity"]):
            raise ValueError(f"identity {seen.a!r} differs from {state['identity'] or seen.b!r}")
        return state | {"dim": state["dim"] or seen.lo, "identity": state["identity"] or seen.a}

    def _write(self, rows: DataFrame, touched: set[int], state: dict) -> None:
        """Commits the rows as what the touched buckets hold."""
        if touched:
            name = f"v{uuid.uuid4()}"
            rows.select(*COLUMNS, self._bucket(state).alias("bucket")).write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
            files = {b: f for b, f in state["files"].items() if int(b) not in touched}
            for f in self._fs.listStatus(self._path(f"{self.folder}/{name}")):
                at = f.getPath().getName()
                if at.startswith("bucket="):
                    files[at[7:]] = f"{name}/{at}"
            state = state | {"files": files}
        self._commit(state)

    def _held(self, rows: DataFrame) -> DataFrame:
        """A batch, made once however often it is read."""
        shared_folder(self.spark)
        return rows.checkpoint()

    def upsert(self, rows: DataFrame, position: str | None = None) -> None:
        """Rows by id, new over old; of rows with one id the last by `position` wins, without which ids mustn't repeat."""
        state = self._state()
        if position:
            rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy(F.col(position).desc()))).where("__n = 1")
        batch = self._held(self._complete(rows))
        if not position and batch.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("ids of rows repeat, and no position says which is the last")
        state = self._checked(batch, state)
        # rows with these ids may lie in other documents' buckets
        old = self._read(state).select("id", "document_id").join(batch.select("id"), "id", "left_semi")
        touched = self._touched(batch, state) | self._touched(old, state)
        self._write(self._read(state, touched).join(batch.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(batch), touched, state)

    def replace_documents(self, documents: DataFrame, rows: DataFrame) -> None:
        """All rows of the documents (document_id) by the given ones; a document without rows is deleted. All or nothing."""
        state = self._state()
        batch = self._held(self._complete(rows))
        ids = documents.select("document_id")
        double = ids.groupBy("document_id").count().where("count > 1 or document_id is null or trim(document_id) = ''").limit(1).count()
        if double:
            raise ValueError("document ids must be given, once each")
        if batch.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("ids of rows repeat")
        if batch.join(ids, "document_id", "left_anti").limit(1).count():
            raise ValueError("rows of a document that isn't replaced")
        kept = self._read(state).select("id", "document_id").join(ids, "document_id", "left_anti")
        if batch.join(kept.select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("an id belongs to a document that stays")
        state = self._checked(batch, state)
        touched = {b for b in self._touched(ids, state) if str(b) in state["files"]} | self._touched(batch, state)
        self._write(self._read(state, touched).join(ids, "document_id", "left_anti").select(*COLUMNS).unionByName(batch), touched, state)

    def delete_document(self, document_id: str) -> None:
        state = self._state()
        touched = self._touched(self.spark.createDataFrame([(document_id,)], "document_id string"), state)
        self._write(self._read(state, touched).where(~F.col("document_id").eqNullSafe(document_id)).select(*COLUMNS), touched, state)

    def reset(self) -> None:
        """No rows and no latch."""
        state = self._state()
        self._commit({"version": state["version"], "buckets": self.buckets, "files": {}, "identity": None, "dim": None})
