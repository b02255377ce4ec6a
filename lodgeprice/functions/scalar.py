"""Scalar column rules: dates (F3), flags (F4), ratios (F13, F14), defaults (F19),
tiers (F20), rounding (F21), log target (F22), display fields (F23), clamps (P14, P15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MIN_PRICE, PROFESSIONAL_HOST_MIN_LISTINGS, REFERENCE_DATE
from ._col import as_col, lit_or_col


def days_since(c, reference_date: str = REFERENCE_DATE) -> Column:
    """whole days from the date in ``c`` to the reference date; bad text -> null."""
    return F.datediff(F.lit(reference_date).cast("date"), F.try_to_date(as_col(c).cast("string")))


def days_between(start, end) -> Column:
    """G2 helper: whole days from ``start`` to ``end`` (both date-like text); bad -> null."""
    s = F.try_to_date(as_col(start).cast("string"))
    e = F.try_to_date(as_col(end).cast("string"))
    return F.datediff(e, s)


def threshold_flag(c, threshold: float = PROFESSIONAL_HOST_MIN_LISTINGS, fill=None) -> Column:
    """1 when ``c > threshold``. Training: null -> 0. Serving: pass ``fill`` (the default mean)."""
    c = as_col(c)
    if fill is not None:
        c = F.coalesce(c, lit_or_col(fill))
    return F.coalesce(c > F.lit(threshold), F.lit(False)).cast("int")


def per_person(a, accommodates="accommodates", mode: str = "train") -> Column:
    """``a / accommodates``; training maps 0 to 1, serving uses max(accommodates, 1)."""
    acc = as_col(accommodates)
    if mode == "train":
        denom = F.when(acc == 0, F.lit(1)).otherwise(acc)
    else:
        denom = F.greatest(acc, F.lit(1))
    return as_col(a).cast("double") / denom.cast("double")


def fill_default(given, *fallbacks) -> Column:
    """the given value, else the first non-null fallback (average, then constant)."""
    return F.coalesce(as_col(given), *[lit_or_col(f) for f in fallbacks])


def price_tier(price, low, high) -> Column:
    """<= low -> red, <= high -> orange, else green."""
    p = as_col(price)
    return F.when(p <= lit_or_col(low), F.lit("red")).when(p <= lit_or_col(high), F.lit("orange")).otherwise(F.lit("green"))


def round_cents(c) -> Column:
    """half-even rounding to two decimals, as Python's ``round`` on a float."""
    return F.bround(as_col(c), 2)


def price_floor(c, floor: float = MIN_PRICE) -> Column:
    """Never below the floor."""
    return F.greatest(as_col(c), F.lit(floor))


def log_target(c) -> Column:
    """F22 forward."""
    return F.log1p(as_col(c))


def inverse_log_target(c) -> Column:
    """F22 inverse."""
    return F.expm1(as_col(c))


def display_text(c) -> Column:
    """null -> 'N/A', else the value as text."""
    return F.coalesce(as_col(c).cast("string"), F.lit("N/A"))


def display_int(c) -> Column:
    """truncated to an integer, null -> 'N/A'."""
    return F.coalesce(as_col(c).cast("bigint").cast("string"), F.lit("N/A"))


def clamp_field(c, lo: float, hi: float | None, default: float, zero_is_missing: bool = False) -> Column:
    """Parse, default when unparsable (or 0 when ``zero_is_missing``), then clamp to [lo, hi]."""
    raw = as_col(c).cast("string")
    v = F.coalesce(raw.try_cast("double"), F.lit(None).cast("double"))
    if zero_is_missing:
        v = F.when(v == 0, F.lit(None).cast("double")).otherwise(v)
    v = F.coalesce(v, F.lit(float(default)))
    if hi is not None:
        v = F.least(F.lit(float(hi)), v)
    return F.greatest(F.lit(float(lo)), v)
