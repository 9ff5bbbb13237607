"""Secret scans with two character Markov models.

One model is trained on random strings, the other on ordinary identifiers. A
candidate, a run of LEAST or more ASCII letters, digits, '+', '/', '_' and '-' with
both a letter and no break, is a secret when its log-likelihood ratio per character
is above a threshold calibrated on held-out labelled samples. A candidate may hold a
secret among ordinary characters, as paths, URLs and names do: its stretches of LEAST or
more characters, that end at '/', '_' or '-' if one is near, whose ratios exceed that threshold by enough in
all, again calibrated, are secrets too, and are reported in place of the candidate.

Defined results: null and empty texts have no candidates; rows without a doc_id are
left out; runs without a letter (numbers, rules) are no candidates; repeated rows give
repeated results; other columns are ignored. Offsets count characters.
"""

from __future__ import annotations

import random
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T

LEAST = 16
#: Places within which a stretch ends at a cut.
NEAR = 6
#: Labelled samples of each kind, at most.
SAMPLES = 6000
_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_N = len(_CHARS) + 1  # 0 is the start
_CODE = np.zeros(0x110000, np.uint8)
for _i, _c in enumerate(_CHARS):
    _CODE[ord(_c)] = _i + 1
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


class Model(NamedTuple):
    """ratio[a, b, c]: log-likelihood ratio of character c after a and b."""

    ratio: np.ndarray
    threshold: float
    #: What the ratios of a stretch have above the threshold, summed, at least.
    excess: float = 0.0


def random_strings(n: int, seed: int = 7) -> list[str]:
    """Labelled samples of secrets: random strings over the alphabets that keys and tokens are made of."""
    r = random.Random(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", _CHARS[:62], _CHARS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _CHARS[:26] + "0123456789"]
    return ["".join(r.choices(r.choice(alphabets), k=r.randrange(LEAST, 49))) for _ in range(n)]


def identifiers(words: list[str], n: int, seed: int = 11) -> list[str]:
    """Labelled samples of ordinary identifiers: words, alone and joined as names, paths and constants are."""
    r = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["name"]
    out = []
    for i in range(n):
        parts = [r.choice(words).lower() for _ in range(r.randrange(1, 5))]
        kind = i % 6
        joined = "".join(parts) if kind == 0 else "".join(p.capitalize() for p in parts) if kind == 1 else "_".join(parts) if kind == 2 else "-".join(parts) if kind == 3 else "/".join(parts) if kind == 4 else "_".join(parts).upper()
        out.append(joined + (str(r.randrange(1, 100)) if r.random() < 0.15 else ""))
    return out


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the strings, each after two zeros, and where each string starts."""
    joined = "".join("\0\0" + s for s in strings)
    return _CODE[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.int64), np.cumsum([0] + [len(s) + 2 for s in strings[:-1]])


def _log(strings: list[str]) -> np.ndarray:
    """log P(c | a, b), smoothed by P(c | b) and that by P(c)."""
    c, start = _codes(strings)
    inner = np.ones(len(c), bool)
    inner[start] = inner[start + 1] = False
    at = np.flatnonzero(inner)
    three = np.bincount((c[at - 2] * _N + c[at - 1]) * _N + c[at], minlength=_N**3).reshape(_N, _N, _N).astype(float)
    one = three.sum((0, 1)) + 0.5
    one /= one.sum()
    two = three.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    return np.log((three + 5 * two) / (three.sum(2, keepdims=True) + 5))


def fit(secrets: list[str], ordinary: list[str]) -> Model:
    """Train on three quarters of each kind, calibrate on the rest: least errors, ordinary ones counting twice."""
    train = [[s for i, s in enumerate(x) if i % 4] for x in (secrets, ordinary)]
    held = [[s for s in x[::4] if len(s) >= LEAST] for x in (secrets, ordinary)]
    model = Model(_log(train[0]) - _log(train[1]), 0.0)
    a, b = (np.array([score(model, s) for s in x]) for x in held)
    cuts = np.linspace(-1, 2, 121)
    errors = [((a <= t).mean() if len(a) else 0) + 2 * ((b > t).mean() if len(b) else 0) for t in cuts]
    best = np.flatnonzero(np.array(errors) == min(errors))
    model = model._replace(threshold=float(cuts[best[len(best) // 2]]))
    long = ["/".join(held[1][i : i + 6]) for i in range(0, len(held[1]), 6)]
    a, b = (np.array([_best(_ratios(model, s) - model.threshold)[2] for s in x]) for x in (held[0], long))
    cuts = np.linspace(0, 60, 121)
    errors = [((a <= t).mean() if len(a) else 0) + 20 * ((b > t).mean() if len(b) else 0) for t in cuts]  # long runs have many places
    best = np.flatnonzero(np.array(errors) == min(errors))
    return model._replace(excess=float(cuts[best[len(best) // 2]]))


def _ratios(model: Model, s: str) -> np.ndarray:
    c, _ = _codes([s])
    return model.ratio[c[:-2], c[1:-1], c[2:]]


def _best(x: np.ndarray) -> tuple[int, int, float]:
    """(start, end, sum) of the slice with the largest sum."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    gain = total - np.minimum.accumulate(total)
    end = int(gain.argmax())
    return int(total[: end + 1].argmin()), end, float(gain[end])


def stretches(x: np.ndarray, cut: np.ndarray, letter: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Slices of x with sums above `least` that have LEAST places and a letter; an end moves to the end of x or a cut that lies within NEAR places."""
    out, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        a, b, gain = _best(x[lo:hi])
        if gain <= least:
            continue
        a, b = lo + a, lo + b
        cuts = lo + np.flatnonzero(cut[lo:hi])
        start, end = (int(near[np.abs(near - e).argmin()]) for near, e in ((np.append(lo, cuts + 1), a), (np.append(cuts, hi), b)))
        if abs(start - a) <= NEAR and start < b:
            a = start
        if abs(end - b) <= NEAR and end > a:
            b = end
        a, b = 0 if a <= NEAR else a, len(x) if b >= len(x) - NEAR else b
        if b - a >= LEAST and letter[a:b].any():
            out.append((a, b))
        todo += [(lo, a), (b, hi)]
    return sorted(out)


def score(model: Model, s: str) -> float:
    return float(_ratios(model, s).mean()) if s else 0.0


def candidates(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates among code points."""
    inside = np.zeros(len(cp) + 2, np.int8)
    inside[1:-1] = _CODE[cp] > 0
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[0::2], edge[1::2]
    long = end - start >= LEAST
    start, end = start[long], end[long]
    letters = np.concatenate(([0], np.cumsum((_CODE[cp] > 0) & (_CODE[cp] <= 52))))
    some = letters[end] > letters[start]
    return start[some], end[some]


def found(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(text, start, end, score) of the secrets."""
    cp, first = T.code_points(texts)
    start, end = candidates(cp)
    size = end - start
    run = np.repeat(np.arange(len(start)), size)
    at = start[run] + np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    k = at - start[run]
    c = _CODE[cp].astype(np.int64)
    ratio = model.ratio[np.where(k > 1, c[at - 2], 0), np.where(k > 0, c[at - 1], 0), c[at]]
    s = np.bincount(run, ratio, len(start)) / np.maximum(size, 1)
    over = ratio - model.threshold
    whole = s > model.threshold
    first_of = np.cumsum(size) - size
    got = []
    for i in np.flatnonzero(whole | (np.bincount(run, np.maximum(over, 0), len(start)) > model.excess)).tolist():
        part = slice(first_of[i], first_of[i] + size[i])
        codes = c[at[part]]
        inside = stretches(over[part], codes > 63, codes <= 52, model.excess)
        if whole[i] and not inside:
            inside = [(0, size[i])]
        got += [(start[i] + a, start[i] + b, ratio[part][a:b].mean()) for a, b in inside]
    start, end = (np.array([g[k] for g in got], np.int64) for k in (0, 1))
    doc = np.searchsorted(first, start, "right") - 1
    return doc, start - first[doc], end - first[doc], np.array([g[2] for g in got], float)


def train(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None) -> Model:
    """Fit on a bounded sample of `labelled` (sample string, is_secret boolean), or, where there are no labels, on
    SAMPLES random strings and as many identifiers made of the commonest words, counted over all documents."""
    if labelled is not None:
        T.shared_folder(spark)
        rows = labelled.where("sample is not null and is_secret is not null").select("sample", "is_secret").orderBy(F.xxhash64("sample"), "sample").limit(2 * SAMPLES).checkpoint().collect()
        return fit([r.sample for r in rows if r.is_secret], [r.sample for r in rows if not r.is_secret])
    words = T.prepared(docs, "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(4 * SAMPLES)
    # written first, since a limit that is collected sends as many rows of each partition to the driver
    T.shared_folder(spark)
    return fit(random_strings(SAMPLES), identifiers([r.w for r in words.checkpoint().collect()], SAMPLES))


def scan(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, score) of every secret in every document; a map without a shuffle."""
    shared = spark.sparkContext.broadcast(model)

    def rows(batch, texts):
        doc, start, end, s = found(shared.value, texts)
        return batch.column("doc_id").take(pa.array(doc)), start, end, s

    return T.prepared(docs, "text").where("text is not null").mapInArrow(T.in_slices(rows, SCHEMA), "doc_id long, start int, end int, score double")
