"""Language identification, words first, with back-off to shorter and shorter character n-grams.

A word that the training sample has scores its log-frequency in each language.
Any other word backs off: the longest n (from 5 down to 1) for which at least one
of its character n-grams, with a mark at either end, is known decides, by the mean
log-frequency of the known ones. A document's score per language is the sum over
its words.

Defined results: null and empty texts, and those without letters or digits or any
known n-gram, have a null language and a margin of 0; of languages with equal
scores the alphabetically first wins; rows without a doc_id are left out;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T

#: Labelled documents for each language that the model is fitted on, at most.
SAMPLE = 400
LONGEST = 5
SCHEMA = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("margin", pa.float64())])


class Table(NamedTuple):
    """Sorted hashes and their log-frequencies in each language."""

    keys: np.ndarray
    logs: np.ndarray

    def find(self, x: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(x), -1)
        i = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return np.where(self.keys[i] == x, i, -1)


class Model(NamedTuple):
    languages: list[str]
    words: Table
    grams: list[Table]


def _marked(w: T.Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some words, each between marks, end to end; the word of each."""
    size = (w.end - w.start)[rows] + 2
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    owner = np.repeat(np.arange(len(rows)), size)
    at = np.arange(size.sum()) - first[owner]
    cp = w.cp[np.clip(w.start[rows][owner] + at - 1, 0, len(w.cp) - 1)].copy()
    cp[(at == 0) | (at == size[owner] - 1)] = 95
    return cp, owner


def _grams(cp: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within each word, and their words."""
    if len(cp) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: len(cp) - n + 1] == owner[n - 1 :])
    if n == 1:
        at = at[cp[at] != 95]  # a mark alone says nothing
    x = np.zeros(len(at), np.uint64)
    for k in range(n):
        x = x * np.uint64(0x9E3779B97F4A7C15) + cp[at + k] + np.uint64(1)
    return T.mix(x), owner[at]


def _table(counts: list[list[np.ndarray]]) -> Table:
    """Log-frequencies of everything that any language's sample has; counts: by language, lists of hashes."""
    each = [np.unique(np.concatenate(c), return_counts=True) if c else (np.zeros(0, np.uint64), np.zeros(0, int)) for c in counts]
    keys = np.unique(np.concatenate([k for k, _ in each])) if each else np.zeros(0, np.uint64)
    logs = np.zeros((len(keys), len(counts)))
    for j, (k, c) in enumerate(each):
        n = np.zeros(len(keys))
        n[np.searchsorted(keys, k)] = c
        logs[:, j] = np.log((n + 0.5) / (c.sum() + 0.5 * (len(keys) + 1)))
    return Table(keys, logs)


def fit(texts: dict[str, list[str]]) -> Model:
    """Count the words of each language's texts, and the n-grams of its distinct words: they serve for unseen ones."""
    languages = sorted(texts)
    words, grams = [], [[] for _ in range(LONGEST)]
    for lang in languages:
        cw, cg, seen = [], [[] for _ in range(LONGEST)], np.zeros(0, np.uint64)
        for i in range(0, len(texts[lang]), 50):
            w = T.words(texts[lang][i : i + 50])
            cw.append(w.hash)
            distinct, rows = np.unique(w.hash, return_index=True)
            new = ~np.isin(distinct, seen)
            seen = np.union1d(seen, distinct)
            cp, owner = _marked(w, rows[new])
            for n in range(LONGEST):
                cg[n].append(_grams(cp, owner, n + 1)[0])
        words.append(cw)
        for n in range(LONGEST):
            grams[n].append(cg[n])
    return Model(languages, _table(words), [_table(g) for g in grams])


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """The score of each text in each language; rows of zeros where nothing is known."""
    out = np.zeros((len(texts), len(model.languages)))
    w = T.words(texts)
    if not len(w.hash):
        return out
    distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    at = model.words.find(distinct)
    each = np.zeros((len(distinct), len(model.languages)))
    each[at >= 0] = model.words.logs[at[at >= 0]]
    rest = np.flatnonzero(at < 0)
    for n in range(LONGEST, 0, -1):
        if not len(rest):
            break
        x, owner = _grams(*_marked(w, first[rest]), n)
        at = model.grams[n - 1].find(x)
        owner, at = owner[at >= 0], at[at >= 0]
        count = np.bincount(owner, minlength=len(rest))
        has = count > 0
        for j in range(len(model.languages)):
            total = np.bincount(owner, model.grams[n - 1].logs[at, j], len(rest))
            each[rest[has], j] = total[has] / count[has]
        rest = rest[~has]
    for j in range(len(model.languages)):
        out[:, j] = np.bincount(w.doc, each[inverse, j], len(texts))
    return out


def train(spark: SparkSession, docs: DataFrame) -> Model:
    """Fit on a bounded number of documents of each language, chosen by a hash of the doc_id."""
    ids = T.prepared(docs, "lang").where("lang is not null").withColumn("h", F.xxhash64("doc_id"))
    some = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= SAMPLE).select("doc_id", F.col("lang").alias("language")).dropDuplicates(["doc_id"])
    texts: dict[str, list[str]] = {}
    for r in T.prepared(docs, "text").join(F.broadcast(some), "doc_id").where("text is not null").orderBy("doc_id").select("language", "text").toLocalIterator():
        texts.setdefault(r.language, []).append(r.text)
    return fit(texts)


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, margin over the second language) of every document; a map without a shuffle."""
    shared = spark.sparkContext.broadcast(model)

    def rows(batch, texts):
        m = shared.value
        s = scores(m, texts)
        if not m.languages:
            return batch.column("doc_id"), [None] * len(texts), np.zeros(len(texts))
        best = s.argmax(axis=1)
        known = (s != 0).any(axis=1)
        two = np.sort(s, axis=1)
        margin = two[:, -1] - two[:, -2] if s.shape[1] > 1 else np.zeros(len(texts))
        return batch.column("doc_id"), [m.languages[b] if k else None for b, k in zip(best, known)], np.where(known, margin, 0.0)

    return T.prepared(docs, "text").mapInArrow(T.in_slices(rows, SCHEMA), "doc_id long, language string, margin double")
