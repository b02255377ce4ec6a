from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def name_or_value(v) -> Column:
    """A string is a column name, a Column stays, anything else is a literal."""
    if isinstance(v, str):
        return F.col(v)
    return lit_or_col(v)
