"""Vector functions over array columns, as higher-order expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def _total(v: Column) -> Column:
    return F.aggregate(v, _zero(), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths and for zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, clamped; 1 for what can't be compared."""
    c = cosine(a, b)
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | ~(n > 0) | F.isnan(c), 1.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def normalize(a: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def is_unit(a: Column, tolerance: float) -> Column:
    if not tolerance > 0:
        return F.lit(False)
    n = norm(a)
    return F.coalesce((n > 0) & ~F.isnan(n) & (F.abs(n - 1) <= tolerance), F.lit(False))


def euclidean(a: Column, b: Column) -> Column:
    """Infinite for empty vectors and different lengths."""
    d = F.sqrt(_total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), d).otherwise(F.lit(float("inf")))


def finite(a: Column, dim: int | None = None) -> Column:
    """All values finite, and as many as `dim`."""
    ok = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return ok & (F.size(a) == dim) if dim else ok


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def unit_interval(cos: Column) -> Column:
    return clamp01((cos + 1) / 2)


def quantize(a: Column, thresholds: Column) -> Column:
    """Packed words of 64 bits; bit i is set where value i is above threshold i."""
    bits = F.zip_with(a, thresholds, lambda x, t: F.when(x > t, 1).otherwise(0))
    words = F.sequence(F.lit(0), F.ceil(F.size(a) / 64).cast("int") - 1)

    def word(w: Column) -> Column:
        part = F.slice(bits, w * 64 + 1, F.lit(64))
        # bits 0 to 62 as a sum, and bit 63 as the sign, since 2**63 overflows
        low = F.aggregate(F.sequence(F.lit(0), F.least(F.size(part), F.lit(63)) - 1), F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.element_at(part, i + 1).cast("bigint"), i)))
        top = F.when(F.size(part) == 64, F.call_function("shiftleft", F.element_at(part, 64).cast("bigint"), F.lit(63))).otherwise(F.lit(0).cast("bigint"))
        return low.bitwiseOR(top)

    return F.transform(words, word)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which packed vectors differ; 0 for different lengths."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), d).otherwise(0)
