"""Scalar filters over rows with id, document_id, filename and VARIANT metadata."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = ("id", "document_id", "filename")


def checked(filters: dict) -> dict:
    """The filters, or an error for values that aren't scalars."""
    for k, v in filters.items():
        if not isinstance(k, str) or not (v is None or isinstance(v, (str, bool, int, float, Decimal))) or (isinstance(v, float) and not math.isfinite(v)):
            raise ValueError(f"filters compare scalars, not {k}: {v!r}")
    return filters


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def matches(filters: dict, metadata: str = "metadata") -> Column:
    """True for rows that have every value. Reserved names compare strings only. Other keys must be present in the metadata: null
    matches only a null, strings and booleans their own type, and numbers any number of exactly the same value."""
    out = F.lit(True)
    for key, value in checked(filters).items():
        if key in RESERVED:
            out = out & (F.col(key) == value if isinstance(value, str) else F.lit(False))
            continue
        v = F.try_variant_get(metadata, _path(key), "variant")
        kind = F.schema_of_variant(v)
        if value is None:
            one = v.isNotNull() & F.is_variant_null(v)
        elif isinstance(value, bool):
            one = (kind == "BOOLEAN") & (F.try_variant_get(metadata, _path(key), "boolean") == value)
        elif isinstance(value, str):
            one = (kind == "STRING") & (F.try_variant_get(metadata, _path(key), "string") == value)
        else:
            number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
            exact = Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
            if -exact.as_tuple().exponent > 18 or exact.adjusted() >= 20:
                one = number & (F.try_variant_get(metadata, _path(key), "double") == float(value))
            else:
                one = number & (F.try_variant_get(metadata, _path(key), "decimal(38,18)") == F.lit(f"{exact:f}").cast("decimal(38,18)"))
        out = out & F.coalesce(one, F.lit(False))
    return out


def contains(wanted: dict, metadata: str = "metadata") -> Column:
    """JSON containment: the VARIANT metadata has every key of `wanted`, at any depth, with an equal scalar, a containing object, or an
    array that has every element asked for."""

    def member(want: object) -> Callable[[Column], Column]:
        return lambda v: inner(v, want)

    def inner(v: Column, want: object) -> Column:
        if isinstance(want, dict):
            out = F.schema_of_variant(v).startswith("OBJECT")
            for key, value in want.items():
                out = out & inner(F.try_variant_get(v, _path(key), "variant"), value)
            return out
        if isinstance(want, (list, tuple)):
            out = F.schema_of_variant(v).startswith("ARRAY")
            for value in want:
                out = out & F.exists(F.try_variant_get(v, "$", "array<variant>"), member(value))
            return out
        if want is None:
            return v.isNotNull() & F.is_variant_null(v)
        if isinstance(want, bool):
            return (F.schema_of_variant(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == want)
        if isinstance(want, str):
            return (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") == want)
        kind = F.schema_of_variant(v)
        return (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (F.try_variant_get(v, "$", "double") == float(want))

    return F.coalesce(inner(F.col(metadata), wanted), F.lit(False))
