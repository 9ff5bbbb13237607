"""Quality by hierarchical empirical Bayes.

A logistic classifier of a document's surface gives the evidence of its text. Its
probabilities, replaced by labels where there are any, are aggregated by host and by
path within the host. A site's rate is shrunk: a host's toward the global rate, a
path's toward its host's, by Beta priors whose strengths are fitted to how much hosts
and paths differ beyond chance (method of moments). Sparse sites stay near what is above
them. A document's score combines the evidence with the posterior of its path without
the document itself: its value is taken out of the path, the host and the whole before they are
shrunk. Only the two prior strengths, one number each for the corpus, are fitted over all.

Sites come from a table of pages whose URL ends in the document's id; a document without
a page has its `source` as host and its `lang` as path.

Defined results: a null or empty text has the evidence of an empty document; null
source, lang or URL count as the site ''; of several pages of a document the one with
the least page_id counts; rows without a doc_id are left out; rows that repeat a
doc_id count once, by the lowest evidence; labels other than 0 and 1 are ignored, of
contradicting ones the lower counts; without labels of both kinds the evidence is 0.5 for all;
other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T

#: Labelled documents of each kind that the classifier is fitted on, at most.
SAMPLE = 2000
#: Prior strengths stay within these bounds, in documents.
STRENGTHS = (1.0, 1e6)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("evidence", pa.float64())])


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept


def features(texts: list[str]) -> np.ndarray:
    """What the classifier sees of each text."""
    cp, starts = T.code_points(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), np.diff(np.append(starts, len(cp) + 1)))[: len(cp)]
    kind = T.classes()[cp]
    size = np.maximum(np.bincount(doc, minlength=n), 1)
    share = lambda m: np.bincount(doc[m], minlength=n) / size
    w = T.words(texts)
    count = np.bincount(w.doc, minlength=n)
    key = (w.doc.astype(np.uint64) << np.uint64(44)) | (w.hash >> np.uint64(20))
    distinct = np.bincount((np.unique(key) >> np.uint64(44)).astype(np.int64), minlength=n)
    length = np.bincount(w.doc, w.end - w.start, n)
    square = np.bincount(w.doc, (w.end - w.start) ** 2.0, n)
    lines = np.bincount(w.line_doc, minlength=n)
    # lines of a text that repeat another of it
    inner = np.zeros(len(w.line_doc), np.uint64)
    np.add.at(inner, w.line, T.mix(w.hash))
    lkey = np.unique((w.line_doc.astype(np.uint64) << np.uint64(44)) | (inner >> np.uint64(20)))
    dlines = np.bincount((lkey >> np.uint64(44)).astype(np.int64), minlength=n)
    each = np.maximum(count, 1)
    ascii_upper = (cp >= 65) & (cp <= 90)
    return np.stack(
        [
            np.log1p(count), length / each, np.sqrt(np.maximum(square / each - (length / each) ** 2, 0)), distinct / each, share(ascii_upper), share(kind == T.NUMBER),
            share((kind == T.OTHER) & (cp != 44) & (cp != 46)), share(cp == 33), share(cp == 124), share((cp == 44) | (cp == 46)), share(cp == 10), 1 - dlines / np.maximum(lines, 1),
            np.sqrt(share((kind == T.OTHER) & (cp != 44) & (cp != 46))), np.sqrt(1 - dlines / np.maximum(lines, 1)),
        ],
        axis=1,
    )


def fit(good: list[str], bad: list[str], rounds: int = 30, ridge: float = 1.0) -> Model:
    """Logistic regression by Newton's method, both kinds weighted equally."""
    x = np.concatenate([features(t) for t in (good, bad) if t]) if good or bad else np.zeros((0, 14))
    if not good or not bad:
        return Model(np.zeros(14), np.ones(14), np.zeros(15))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    y = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    weight = np.where(y == 1, 0.5 / len(good), 0.5 / len(bad)) * len(y)
    beta = np.zeros(15)
    penalty = np.append(np.full(14, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, beta)


def evidence(model: Model, texts: list[str]) -> np.ndarray:
    """The probability that each text is good, at even prior odds."""
    x = (features(texts) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -12, 12)))


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents, chosen by a hash of the doc_id."""
    texts = []
    for kind in (1, 0):
        some = known_labels(labels).where(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        rows = T.prepared(docs, "text").join(F.broadcast(some), "doc_id").select("doc_id", "text").collect()
        texts.append([r.text or "" for r in sorted(rows, key=lambda r: (r.doc_id, r.text or ""))])
    return fit(*texts)


def sites(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, host, path) of every document."""
    url = F.coalesce(F.col("url"), F.lit(""))
    page = pages.select(
        F.col("page_id"), F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1).alias("p_host"),
        F.regexp_extract(url, r"^[a-z]+://[^/?#]*(/[^?#]*?)/?\d+(?:\.\w+)?/?(?:[?#].*)?$", 1).alias("p_path"),
        F.expr(r"try_cast(regexp_extract(url, '^[a-z]+://[^/?#]*/[^?#]*?(\\d+)(?:\\.\\w+)?/?(?:[?#].*)?$', 1) as bigint)").alias("doc_id"),
    ).where("doc_id is not null")
    page = page.groupBy("doc_id").agg(F.min_by(F.struct("p_host", "p_path"), F.struct("page_id", "p_host", "p_path")).alias("p"))
    own = T.prepared(docs, "source", "lang").groupBy("doc_id").agg(F.min(F.struct("source", "lang")).alias("d"))
    host = F.coalesce("p.p_host", "d.source", F.lit(""))
    return own.join(page, "doc_id", "left").select("doc_id", host.alias("host"), F.coalesce("p.p_path", "d.lang", F.lit("")).alias("path"))


def _strength(groups: DataFrame, around: Column) -> Column:
    """The strength of the Beta prior for groups (n, s) whose rates vary around a rate: method of moments."""
    rate = F.col("s") / F.col("n")
    noise = around * (1 - around)
    spread = F.sum(F.col("n") * (rate - around) ** 2) - F.sum(noise) + F.max(noise)
    beyond = spread / F.greatest(F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.lit(1.0))
    level = F.sum(F.col("n") * noise) / F.sum("n")
    return F.least(F.greatest(F.when(beyond > 0, level / beyond - 1).otherwise(STRENGTHS[1]), F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, pages: DataFrame, model: Model) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, is_good) of every document.

    Texts are read once and not shuffled; what is shuffled is a row of numbers and a site for each document.
    """
    T.shared_folder(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = lambda batch, texts: (batch.column("doc_id"), evidence(shared.value, texts))
    seen = T.prepared(docs, "text").mapInArrow(T.in_slices(rows, SCHEMA), "doc_id long, evidence double").groupBy("doc_id").agg(F.min("evidence").alias("evidence"))
    known = seen.join(sites(docs, pages), "doc_id").join(known_labels(labels), "doc_id", "left").withColumn("v", F.coalesce(F.col("quality").cast("double"), F.col("evidence"))).checkpoint()
    path = known.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("v").alias("s"))
    host = path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = host.agg((F.sum("s") / F.sum("n")).alias("rate"), F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    # one row each, whatever the input
    prior = host.crossJoin(F.broadcast(whole)).agg(*(F.max(c).alias(c) for c in ("rate", "all_s", "all_n")), _strength(host, F.col("rate")).alias("host_strength"))
    hosts = host.crossJoin(F.broadcast(prior)).select("host", "all_s", "all_n", "host_strength", F.col("s").alias("host_s"), F.col("n").alias("host_n"), ((F.col("s") + F.col("rate") * F.col("host_strength")) / (F.col("n") + F.col("host_strength"))).alias("host_rate"))
    paths = path.join(hosts, "host")
    inner = paths.agg(_strength(paths, F.col("host_rate")).alias("path_strength"))
    paths = paths.crossJoin(F.broadcast(inner)).drop("host_rate")
    out = known.join(paths, ["host", "path"])
    # without the document, level by level; a document that is all there is has a rate of 0.5 above it
    rate = F.when(F.col("all_n") > 1, (F.col("all_s") - F.col("v")) / (F.col("all_n") - 1)).otherwise(0.5)
    host_rate = (F.col("host_s") - F.col("v") + rate * F.col("host_strength")) / (F.col("host_n") - 1 + F.col("host_strength"))
    rest = (F.col("s") - F.col("v") + host_rate * F.col("path_strength")) / (F.col("n") - 1 + F.col("path_strength"))
    score = 1 / (1 + F.exp(-(_logit(F.col("evidence")) + _logit(rest))))
    return out.select("doc_id", "evidence", host_rate.alias("host_rate"), rest.alias("path_rate"), score.alias("score"), (score >= 0.5).alias("is_good"))
