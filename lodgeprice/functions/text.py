"""Text parsing and naming: money (F1), first number (F2), slugs (F5, F6), JSON lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col

# Name rules per kind of category (which characters become '_', which vanish).
# kind -> (chars replaced by '_', chars removed)
_SLUG_RULES = {
    "room": (" -/", ""),
    "property": (" -/", ""),
    "district": (" -", "."),
    "landmark": (" -", ""),
    "amenity": (" -/–", ".':"),
}
_UMLAUTS = (("ö", "oe"), ("ä", "ae"), ("ü", "ue"))


def money(c) -> Column:
    """strip every '$' and ',' and read a double; null stays null, junk becomes null."""
    return F.regexp_replace(as_col(c), r"[$,]", "").try_cast("double")


def money_is_junk(c) -> Column:
    """True when a non-null price text does not parse (the original raised on these)."""
    c = as_col(c)
    return c.isNotNull() & money(c).isNull()


def first_number(c) -> Column:
    """first ``\\d+\\.?\\d*`` in the text as a double; no match or null -> null."""
    hit = F.regexp_extract(as_col(c), r"[0-9]+\.?[0-9]*", 0)
    return F.nullif(hit, F.lit("")).try_cast("double")


def slug(name: str, kind: str) -> str:
    """F5 (driver-side, for column names): lower case, separators to '_', umlauts spelled out."""
    to_underscore, removed = _SLUG_RULES[kind]
    s = name.lower()
    for ch in to_underscore:
        s = s.replace(ch, "_")
    for a, b in _UMLAUTS:
        s = s.replace(a, b)
    for ch in removed:
        s = s.replace(ch, "")
    return s


def collapse_underscores(name: str) -> str:
    """runs of '_' become one."""
    return re.sub(r"_+", "_", name)


def column_name(prefix: str, value: str, kind: str) -> str:
    return collapse_underscores(prefix + slug(value, kind))


def slug_col(c, kind: str, collapse: bool = True) -> Column:
    """F5 (+ F6 when ``collapse``) as a column expression (same rules as :func:`slug`)."""
    to_underscore, removed = _SLUG_RULES[kind]
    e = F.lower(as_col(c))
    e = F.regexp_replace(e, "[" + re.escape(to_underscore) + "]", "_")
    for a, b in _UMLAUTS:
        e = F.replace(e, F.lit(a), F.lit(b))
    if removed:
        e = F.regexp_replace(e, "[" + re.escape(removed) + "]", "")
    return F.regexp_replace(e, "_+", "_") if collapse else e


def json_list(c) -> Column:
    """JSON array of strings; null or malformed text -> empty array.

    Spark's parser differs from Python's ``json.loads`` on three corner cases
    (object, trailing text, nested list); those follow Spark.
    """
    return F.coalesce(F.from_json(as_col(c), "array<string>"), F.array().cast("array<string>"))
