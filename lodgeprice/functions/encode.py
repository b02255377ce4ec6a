"""Category encodings: one-hot (F8), top-k one-hot with 'other' (F9), multi-hot amenities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AMENITIES
from ._col import as_col
from .text import column_name


def one_hot(c, values: list[str], prefix: str, kind: str) -> list[Column]:
    """F8: ``<prefix><slug>`` = 1 where the column equals the value; null or unknown -> all 0."""
    c = as_col(c)
    return [F.coalesce(c == F.lit(v), F.lit(False)).cast("int").alias(column_name(prefix, v, kind)) for v in values]


def one_hot_top(c, top_values: list[str], prefix: str = "property_", kind: str = "property",
                mode: str = "train", other_literal: str = "Other") -> list[Column]:
    """one column per kept value plus ``<prefix>other``.

    ``mode="train"``: other = not among the kept values, null counts as other.
    ``mode="serve"``: other = the value is literally ``other_literal``.
    """
    c = as_col(c)
    cols = one_hot(c, top_values, prefix, kind)
    if mode == "train":
        other = (~F.coalesce(c.isin(*top_values), F.lit(False))) if top_values else F.lit(True)
    else:
        other = F.coalesce(c == F.lit(other_literal), F.lit(False))
    return cols + [other.cast("int").alias(prefix + "other")]


def amenity_names(amenities: list[str] = AMENITIES) -> list[str]:
    return [column_name("has_", a, "amenity") for a in amenities]


def multi_hot(arr, amenities: list[str] = AMENITIES) -> list[Column]:
    """``has_<slug>`` per amenity by exact, case-sensitive membership; null array -> 0."""
    arr = as_col(arr)
    return [
        F.coalesce(F.array_contains(arr, F.lit(a)), F.lit(False)).cast("int").alias(n)
        for a, n in zip(amenities, amenity_names(amenities))
    ]
