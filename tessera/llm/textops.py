"""Vectorised text primitives shared by the operators of this package.

Everything works on a *slice*: a few hundred thousand characters of many
documents, laid end to end as one array of code points, so that tokenising and
hashing cost a handful of numpy passes instead of a Python step per word.
"""

from __future__ import annotations

import posixpath
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Characters handled at once; a longer document is a slice of its own.
SLICE_CHARS = 600_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        k = unicodedata.category(ch)[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
        elif ch.isspace() and c not in range(0x1C, 0x20):
            out[c] = SPACE
    return out


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """True for letters, numbers and combining marks."""
    out = (classes() == LETTER) | (classes() == NUMBER)
    for c in np.flatnonzero(classes() == OTHER):
        if unicodedata.category(chr(c))[0] == "M":
            out[c] = True
    return out


@lru_cache(maxsize=1)
def char_codes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept between calls up to the slice size."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_CHARS + 1)
        made = []
        for base in (_P, _P_INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 8 * SLICE_CHARS:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a newline between them, and the start of each text."""
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    return cp, starts


def range_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of cp[start:end] for many ranges, through prefix sums."""
    pw, ipw = powers(len(cp) + 1)
    h = np.zeros(len(cp) + 1, np.uint64)
    x = char_codes()[cp]
    x *= pw[: len(cp)]
    np.cumsum(x, out=h[1:])
    return mix((h[end] - h[start]) * ipw[start])


class Words(NamedTuple):
    """Words of a slice. doc: index of the text; line: index of the line over the slice."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    line: np.ndarray
    line_doc: np.ndarray
    line_no: np.ndarray
    cp: np.ndarray


def words(texts: list[str]) -> Words:
    """Words of the lower-case texts: runs of letters, numbers and marks. Lines end at newlines."""
    cp, starts = code_points([t.lower() for t in texts])
    is_word = np.zeros(len(cp) + 2, np.int8)
    is_word[1:-1] = word_chars()[cp]
    edge = np.flatnonzero(np.diff(is_word))
    start, end = edge[0::2], edge[1::2]
    newline = np.flatnonzero(cp == 10)
    line_start = np.concatenate(([0], newline + 1))
    line_doc = np.searchsorted(starts, line_start, "right") - 1
    first = np.searchsorted(line_start, starts)
    line = np.searchsorted(newline, start)
    return Words(range_hashes(cp, start, end), start, end, line_doc[line], line, line_doc, np.arange(len(line_start)) - first[line_doc], cp)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of a batch, cut so that each has about `most` characters."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i, texts[lo:i]
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


def group_starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))


def run_positions(start: np.ndarray, n: int) -> np.ndarray:
    """The position of each of n rows within its run."""
    return np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def prepared(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator needs, without rows that have no doc_id."""
    return docs.select(F.col("doc_id").cast("long"), *columns).where(F.col("doc_id").isNotNull())


def in_slices(fn, schema: pa.Schema, column: str = "text"):
    """A mapInArrow function from one that turns (batch rows of a slice, its texts) into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch, column):
                made = fn(batch.slice(lo, hi - lo), texts)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(made, schema)], schema=schema)

    return run


#: Tasks whose tables are merged at a time.
FAN_IN = 128


#: Entries of a table that are merged together.
BLOCK = 1 << 18


def merged_blocks(blocks: DataFrame, how: str) -> np.ndarray:
    """Tables that tasks sent, merged: with as_blocks, `or` of bits; with as_counts, `log`, the logarithm of the sum.

    Logarithms are bytes: 0 and 1 stand for a sum of 0 and 1, x >= 2 for about 2 ** ((x + 6) / 8). The merging is a tree of
    FAN_IN tables to a group, and the result is as large as one task's table, whatever the input; sums are made bytes before they leave the workers.
    """
    add = how == "log"

    def merging(last: bool):
        def merge(table: pa.Table) -> pa.Table:
            out = np.zeros(BLOCK, np.uint64) if add else None
            for data in table.column("data"):
                raw = zlib.decompress(data.as_py())
                if add:
                    where, n = np.frombuffer(raw, np.uint32).reshape(2, -1)
                    out[where] += n
                elif out is None:
                    out = np.frombuffer(raw, np.uint8).copy()
                else:
                    out |= np.frombuffer(raw, np.uint8)
            if add and last:
                out = np.where(out < 2, out, 2 + 8 * np.log2(np.maximum(out, 2) / 2)).astype(np.uint8)
            elif add:
                out = _sparse(where := np.flatnonzero(out), out[where])
            b, part = (table.column(c)[0].as_py() for c in ("block", "part"))
            return pa.Table.from_pydict({"block": [b], "part": [part], "data": [zlib.compress(out.tobytes(), 1)]}, BLOCKS)

        return merge

    tasks = blocks.rdd.getNumPartitions()
    while True:
        last = tasks <= FAN_IN
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(merging(last), "block int, part int, data binary")
        tasks = -(-tasks // FAN_IN)
        if last:
            break
    rows = sorted((r.block, bytes(r.data)) for r in blocks.collect())
    return np.concatenate([np.frombuffer(zlib.decompress(d), np.uint8) for _, d in rows]) if rows else np.zeros(0, np.uint8)


BLOCKS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])


def _blocks(parts: list[bytes]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([part] * len(parts), pa.int32()), pa.array([zlib.compress(x, 1) for x in parts], pa.binary())], schema=BLOCKS)


def as_blocks(table: np.ndarray, block: int = BLOCK) -> pa.RecordBatch:
    return _blocks([table[i : i + block].tobytes() for i in range(0, len(table), block)])


def _sparse(where: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack((where.astype(np.uint32), np.minimum(n, 0xFFFFFFFF).astype(np.uint32)))


def as_counts(where: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
    """Blocks of a table of `size` entries from its entries `where`, in order, that aren't 0."""
    edges = np.searchsorted(where, np.arange(0, size + 1, BLOCK))
    return _blocks([_sparse(where[i:j] - np.uint32(k * BLOCK), n[i:j]).tobytes() for k, (i, j) in enumerate(zip(edges[:-1], edges[1:]))])


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in df.columns:
        name = "_" + name
    return name


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession):
    """Removes, at its end, the tables that written() made within it; what reads them must be done by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, from a table written to the shared folder: what checkpoint() does, but in compressed columns.

    Written within temporary(), the table goes at its end; else it is left to the cluster's clean-up, as checkpoints are.
    """
    path = posixpath.join(shared_folder(spark), f"{name}-{uuid.uuid4()}")
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
