"""Readers of texts, vector blobs, an embedding cache and remote embedders."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import framed_identity, normalize_text

MOST_BYTES = 16 << 20


def read_texts(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of the files under a path, by one scan; files over the limit aren't read at all. Rejects say why."""
    if most_bytes <= 0:
        raise ValueError("the limit must be positive")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    good = files.where(F.col("length") <= most_bytes).withColumn("ok", F.is_valid_utf8(F.col("content").cast("string")))
    docs = good.where("ok").select(F.col("path").alias("id"), name.alias("title"), F.lit("text").alias("format"), normalize_text(F.col("content").cast("string")).alias("text"), F.create_map(F.lit("source"), F.lit(path), F.lit("path"), F.col("path"), F.lit("filename"), name).alias("metadata"))
    rejects = files.where(F.col("length") > most_bytes).select("path", F.lit("too large").alias("reason")).union(good.where("not ok").select("path", F.lit("not UTF-8").alias("reason")))
    return docs, rejects


def encode_vector(v: Column, double: bool = False) -> Column:
    """Little-endian bytes of a vector."""
    dtype = "<f8" if double else "<f4"

    @pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, dtype).tobytes())

    return run(v)


def decode_vector(blob: Column, double: bool = False) -> Column:
    """The vector of little-endian bytes; an error unless they are a whole number of values."""
    width, dtype = (8, "<f8") if double else (4, "<f4")

    @pandas_udf("array<double>" if double else "array<float>")
    def run(s: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            if len(b) % width:
                raise ValueError(f"{len(b)} bytes aren't a whole number of values of {width}")
            return np.frombuffer(b, dtype)

        return s.map(one)

    return run(blob)


def cached_embeddings(inputs: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], identity: str, model: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(inputs with `embedding`, cache with what was missing). Each distinct input is looked up and, if missing, embedded once."""
    key = framed_identity(F.lit(identity), F.lit(model), F.col(text))
    keyed = inputs.withColumn("key", key)
    missing = keyed.select("key", text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = missing.select("key", embed(F.col(text)).alias("embedding"))
    grown = cache.select("key", "embedding").unionByName(new)
    return keyed.join(grown, "key", "left").drop("key"), grown


def remote_embedder(url: str, model: str, field: str = "embeddings", batch: int = 64, timeout: float = 60, most_bytes: int = 64 << 20, headers: dict | None = None, newlines: bool = True) -> Callable[[Column], Column]:
    """An embedder behind HTTP: {"model", "input": [...]} in; lists under `field`, or {"data": [{"index", "embedding"}]}, out.

    One request for each batch; exactly one finite vector for each input, put in order by index where there is one.
    """

    def vectors(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts if newlines else [t.replace("\n", " ") for t in texts]}).encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            raw = r.read(most_bytes + 1)
        if len(raw) > most_bytes:
            raise ValueError("the answer is too large")
        got = json.loads(raw)
        out = [d["embedding"] for d in sorted(got["data"], key=lambda d: d["index"])] if "data" in got else got[field]
        if len(out) != len(texts) or len({len(v) for v in out}) > 1 or not np.isfinite(np.array(out, float)).all():
            raise ValueError("not one finite vector of equal length for each input")
        return out

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in vectors(texts[i : i + batch])])

    return run
