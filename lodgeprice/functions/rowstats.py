"""Row-wise statistics over a list of columns (F15–F18); nulls are skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col


def _numbers(cols) -> tuple[list[Column], Column]:
    """The columns as doubles, and how many of them hold a value."""
    xs = [as_col(c).cast("double") for c in cols]
    n = F.lit(0)
    for x in xs:
        n = n + x.isNotNull().cast("int")
    return xs, n


def _total(xs: list[Column]) -> Column:
    """Sum of the non-null values, from the left; written out, as lambdas over arrays are not compiled."""
    out = F.lit(0.0)
    for x in xs:
        out = out + F.coalesce(x, F.lit(0.0))
    return out


def row_mean(cols) -> Column:
    """mean of the non-null values; none -> null."""
    xs, n = _numbers(cols)
    return _total(xs) / F.nullif(n, F.lit(0))


def row_min(cols) -> Column:
    """F16: smallest non-null value (``least`` skips nulls)."""
    return F.least(*[as_col(c) for c in cols])


def row_std(cols, ddof: int = 1) -> Column:
    """standard deviation of the non-null values.

    ``ddof=1`` (sample) is the training-time rule, ``ddof=0`` (population) the
    serving-time rule. Fewer than ``ddof + 1`` values -> null. The mean is
    taken first and squared deviations summed after, for precision.
    """
    xs, n = _numbers(cols)
    mean = _total(xs) / F.nullif(n, F.lit(0))
    ss = _total([(x - mean) * (x - mean) for x in xs])
    return F.sqrt(ss / F.when(n > ddof, n - F.lit(ddof)))


def row_sum(cols) -> Column:
    """sum of flag columns (nulls count as 0)."""
    cols = [F.coalesce(as_col(c), F.lit(0)) for c in cols]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out
