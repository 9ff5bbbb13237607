"""Windows over sequences of scores and vectors.

Every function takes the columns that partition the rows into sequences (`by`) and the one that orders them, so that many
sequences are worked on at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.vector import cosine


def _w(by: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)


def moving_average(rows: DataFrame, value: str, width: int, by: list[str], order: str, single: bool = False) -> DataFrame:
    """Centred mean over width // 2 rows on either side, cut off at the ends; widths under 2 (1 in single precision) change nothing."""
    if width < (1 if single else 2):
        return rows.withColumn("smoothed", F.col(value).cast("double"))
    half = width // 2
    return rows.withColumn("smoothed", F.avg(F.col(value).cast("double")).over(_w(by, order).rowsBetween(-half, half)))


def _mean(vs: Column) -> Column:
    """The mean vector of an array of vectors."""
    total = F.aggregate(F.slice(vs, 2, F.greatest(F.size(vs), F.lit(1))), F.transform(F.element_at(vs, 1), lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vs))


def window_similarity(rows: DataFrame, width: int, by: list[str], order: str, vector: str = "embedding") -> DataFrame:
    """Cosine of the mean of the `width` vectors from each row on and of that from the next row on; windows end with the sequence. The last row has none."""
    w = _w(by, order)
    means = rows.withColumn("__m", _mean(F.collect_list(vector).over(w.rowsBetween(0, max(1, width) - 1))))
    return means.withColumn("__n", F.lead("__m").over(w)).where("__n is not null").withColumn("similarity", cosine(F.col("__m"), F.col("__n"))).drop("__m", "__n")


def _spread(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def adaptive_threshold(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mean - population deviation, within 0.3..0.9; 0.7 for an empty sequence."""
    t = F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.col("mean") - F.col("sd")))
    return _spread(rows, value, by).select(*by, F.when(F.col("mean").isNull(), 0.7).otherwise(t).alias("threshold"))


def boundaries(rows: DataFrame, value: str, threshold: Column, order: str) -> DataFrame:
    """index + 1 wherever the value is below the threshold."""
    return rows.where(F.col(value) < threshold).withColumn("boundary", F.col(order) + 1)


def break_points(rows: DataFrame, value: str, by: list[str], order: str, sensitivity: float = 1.0, neighbours: int = 0) -> DataFrame:
    """Rows below mean - sensitivity * deviation (within 0.1..0.95). With neighbours: the mean of up to so many on either side must exceed it too, where there are any."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    t = F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.avg(value).over(w) - sensitivity * F.stddev_pop(value).over(w)))
    out = rows.withColumn("threshold", t)
    keep = F.col(value) < F.col("threshold")
    if neighbours > 0:
        for name, a, b in (("__before", -neighbours, -1), ("__after", 1, neighbours)):
            out = out.withColumn(name, F.avg(value).over(_w(by, order).rowsBetween(a, b)))
            keep = keep & (F.col(name).isNull() | (F.col(name) > F.col("threshold")))
    return out.where(keep).withColumn("break_at", F.col(order) + 1).drop("__before", "__after")


def gaussian(rows: DataFrame, value: str, sigma: float, by: list[str], order: str) -> DataFrame:
    """Smoothing by a normalised kernel of radius ceil(3 sigma); beyond the ends the first and last value count."""
    if sigma <= 0:
        return rows.withColumn("smoothed", F.col(value).cast("double"))
    r = math.ceil(3 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(kernel)
    w = _w(by, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    # a value at a fixed distance is a lag or a lead, so no row is joined with any other
    at = [F.col(value) if k == 0 else F.coalesce(F.lag(value, -k).over(w), first) if k < 0 else F.coalesce(F.lead(value, k).over(w), last) for k in range(-r, r + 1)]
    return rows.withColumn("smoothed", sum((c * (g / total) for c, g in zip(at, kernel)), F.lit(0.0)))


def gradient(rows: DataFrame, value: str, by: list[str], order: str, name: str = "gradient") -> DataFrame:
    """Central differences, one-sided at the ends; 0 for a single value."""
    w = _w(by, order)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    g = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)
    return rows.withColumn(name, g)


def elbow(rows: DataFrame, value: str, by: list[str], order: str, keep: int = 1, sigma: float = 1.0) -> DataFrame:
    """(by, elbow): the first index of at least `keep` where the second gradient of the smoothed values is largest in size."""
    x = gaussian(rows, value, sigma, by, order)
    x = gradient(gradient(x, "smoothed", by, order, "__g1"), "__g1", by, order, "__g2")
    x = x.withColumn("__i", F.row_number().over(_w(by, order)) - 1).where(F.col("__i") >= keep)
    return x.groupBy(*by).agg(F.min_by("__i", F.struct(-F.round(F.abs("__g2"), 12), F.col("__i"))).alias("elbow"))
