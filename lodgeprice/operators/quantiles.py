"""Exact order statistics without holding a column in one task.

Spark's exact ``percentile``/``median`` aggregate merges every distinct value
of a group into one buffer; for a global aggregate over a continuous column
that is one task holding the whole column. Here the k-th smallest value is
enclosed between real values of the column and the enclosure is narrowed:

1. one pass counts the values of every column;
2. each round, one wide aggregate takes pivots around the wanted rank from
   ``percentile_approx`` over the values still enclosed (a mergeable sketch of
   bounded size), and a second one counts exactly how many values lie below and
   at each pivot;
3. a rank that falls on a pivot is done; any other continues strictly between
   its two nearest pivots;
4. once every open search encloses at most ``GATHER`` values, one pass brings
   those values to the driver, which reads the ranks off them.

A round cuts the number of enclosed values by about ``ACCURACY / 6``, whatever
their range, infinities and denormals included; below ``ACCURACY / 2`` values
the sketch is exact and the round is the last. Every round removes at least the
pivots themselves, so the search always ends. The sketches of all partitions are
merged in one task, which is why they are small: one round and the gathering do
for 10 million values. Only pivots, counts and the ``GATHER`` values of a search
reach the driver, and no row is multiplied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a sketch are off by at most 1 / ACCURACY of the values looked at.
ACCURACY = 2_000
#: Values of one search that the driver may hold.
GATHER = 50_000


@dataclass
class _Search:
    col: str
    rank: int  # 0-based rank among the column's values
    n: int  # values strictly between lo and hi
    below: int = 0  # values at or below lo
    lo: float | None = None
    hi: float | None = None
    value: float | None = None

    def shares(self) -> list[float]:
        """Where to look for pivots, as shares of the enclosed values."""
        at = (self.rank - self.below + 0.5) / self.n
        slack = 2.0 / ACCURACY
        return [at] if 2 * self.n < ACCURACY else [max(0.0, at - slack), min(1.0, at + slack)]

    def narrow(self, pivots: list[tuple[float, int, int]]) -> None:
        """``pivots``: (value, values below it, values up to it), ascending."""
        top = self.below + self.n
        for value, under, upto in pivots:
            if under <= self.rank < upto:
                self.value = value
                return
            if upto <= self.rank:
                self.lo, self.below = value, upto
            else:
                self.hi, top = value, under
                break
        self.n = top - self.below


def kth_smallest(df: DataFrame, wanted: dict, counts: dict | None = None) -> dict[tuple[str, int], float]:
    """Exact k-th smallest value (0-based) per column for the given ranks; nulls and NaN are no values.

    ``wanted`` maps column -> ranks, or column -> function of the column's
    value count returning ranks. Ranks outside ``[0, n)`` give no entry.
    ``counts`` (if given) is filled with the value count per column.
    """
    cols = [c for c in wanted if wanted[c]]
    if not cols:
        return {}
    name = {c: f"c{i}" for i, c in enumerate(cols)}
    number = {c: F.col(c).cast("double") for c in cols}
    # several passes read the same few columns (spills to disk, recomputed on loss)
    values = df.select(*[F.when(~F.isnan(number[c]), number[c]).alias(name[c]) for c in cols]).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        total = values.agg(*[F.count(name[c]).alias(name[c]) for c in cols]).first()
        searches: list[_Search] = []
        for c in cols:
            n = int(total[name[c]])
            if counts is not None and n:
                counts[c] = n
            ranks = wanted[c](n) if callable(wanted[c]) else wanted[c]
            searches += [_Search(c, k, n) for k in sorted(set(ranks)) if 0 <= k < n]
        while open_ := [s for s in searches if s.value is None]:
            if all(s.n <= GATHER for s in open_):
                _gather(values, name, open_)
            else:
                _round(values, name, open_)
    finally:
        values.unpersist()
    return {(s.col, s.rank): s.value for s in searches}


def _inside(v, lo: float | None, hi: float | None):
    """True for the values strictly between the bounds."""
    inside = F.lit(True) if lo is None else v > F.lit(lo)
    return inside if hi is None else inside & (v < F.lit(hi))


def _gather(values: DataFrame, name: dict[str, str], open_: list[_Search]) -> None:
    """All values still enclosed, at most ``GATHER`` a search, in one pass; their order answers every open search."""
    spans = sorted({(s.col, s.lo, s.hi) for s in open_}, key=str)
    cells = [F.when(_inside(F.col(name[c]), lo, hi), F.struct(F.lit(i).alias("i"), F.col(name[c]).alias("v")))
             for i, (c, lo, hi) in enumerate(spans)]
    found = values.select(F.explode(F.array_compact(F.array(*cells))).alias("e")).select("e.i", "e.v").where(
        F.col("v").isNotNull()).toArrow()
    at, v = found.column("i").to_numpy(), found.column("v").to_numpy()
    ordered = {span: np.sort(v[at == i]) for i, span in enumerate(spans)}
    for s in open_:
        s.value = float(ordered[s.col, s.lo, s.hi][s.rank - s.below])


def _round(values: DataFrame, name: dict[str, str], open_: list[_Search]) -> None:
    """One narrowing of every open search: a pass for pivots and a pass for their counts."""
    spans: dict[tuple, set] = {}
    for s in open_:
        spans.setdefault((s.col, s.lo, s.hi), set()).update(s.shares())
    sketches = []
    for i, ((c, lo, hi), shares) in enumerate(spans.items()):
        v = F.col(name[c])
        sketches.append(F.percentile_approx(F.when(_inside(v, lo, hi), v), sorted(shares), ACCURACY).alias(f"s{i}"))
    found = values.agg(*sketches).first()
    pivots: dict[str, set] = {}
    for i, (c, _, _) in enumerate(spans):
        pivots.setdefault(c, set()).update(found[f"s{i}"])
    marks = [(c, p) for c in pivots for p in sorted(pivots[c])]
    exact = values.agg(*[e for i, (c, p) in enumerate(marks) for e in (
        F.count_if(F.col(name[c]) < F.lit(p)).alias(f"u{i}"), F.count_if(F.col(name[c]) <= F.lit(p)).alias(f"t{i}"))]).first()
    counted: dict[str, list] = {}
    for i, (c, p) in enumerate(marks):
        counted.setdefault(c, []).append((p, int(exact[f"u{i}"]), int(exact[f"t{i}"])))
    for s in open_:
        s.narrow([m for m in counted[s.col] if (s.lo is None or m[0] > s.lo) and (s.hi is None or m[0] < s.hi)])


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact median per column (midpoint of the two middle values for even n); all null -> None."""
    counts: dict[str, int] = {}
    kth = kth_smallest(df, {c: (lambda n: [(n - 1) // 2, n // 2]) for c in cols}, counts=counts)
    out: dict[str, float | None] = {}
    for c in cols:
        n = counts.get(c, 0)
        if n == 0:
            out[c] = None
            continue
        a, b = kth[(c, (n - 1) // 2)], kth[(c, n // 2)]
        out[c] = a if a == b else (a + b) / 2.0
    return out


def _positions(n: int, probs: list[float]) -> list[int]:
    ranks = []
    for p in probs:
        h = (n - 1) * p
        ranks += [int(math.floor(h)), int(math.ceil(h))]
    return ranks


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Linear-interpolated quantiles (position ``(n-1)·p``), as numpy/pandas default and DuckDB quantile_cont."""
    counts: dict[str, int] = {}
    kth = kth_smallest(df, {col: lambda n: _positions(n, probs)}, counts=counts)
    n = counts.get(col, 0)
    if n == 0:
        return [None for _ in probs]
    out = []
    for p in probs:
        h = (n - 1) * p
        lo, hi = int(math.floor(h)), int(math.ceil(h))
        a, b = kth[(col, lo)], kth[(col, hi)]
        out.append(a if a == b else a + (h - lo) * (b - a))
    return out
