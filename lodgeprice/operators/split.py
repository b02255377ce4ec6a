"""Stable split (T1), folds (T2) and synthetic rows from a profile.

The split is a pure function of the id (an md5 slice), so every job gets the
same rows regardless of partitioning, file order or executor loss; the same
rule runs in SQL engines. ``randomSplit`` would change with partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CV_FOLDS, SPLIT_SEED, TEST_FRACTION


def _threshold(fraction: float) -> int:
    return int(round(fraction * 65536))


def is_test(id_col="id", seed: int = SPLIT_SEED, test_fraction: float = TEST_FRACTION) -> Column:
    """True for the test part (about ``test_fraction`` of ids)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int") < _threshold(test_fraction)


def split_sql(id_col: str = "id", seed: int = SPLIT_SEED, test_fraction: float = TEST_FRACTION) -> str:
    """The same rule as SQL text (for the DuckDB oracle)."""
    return f"cast('0x' || substring(md5(concat({id_col}, '|{seed}')), 1, 4) as int) < {_threshold(test_fraction)}"


def with_set(df: DataFrame, id_col: str = "id", seed: int = SPLIT_SEED) -> DataFrame:
    """Tag each row ``train``/``test`` (the union of both parts with a constant tag)."""
    return df.withColumn("set", F.when(is_test(id_col, seed), F.lit("test")).otherwise(F.lit("train")))


def split_table(df: DataFrame, id_col: str = "id", seed: int = SPLIT_SEED) -> DataFrame:
    """T1 + O1: the ``(id, set)`` table sorted by id."""
    return with_set(df.select(id_col), id_col, seed).orderBy(id_col)


def train_part(df: DataFrame, id_col: str = "id", seed: int = SPLIT_SEED) -> DataFrame:
    return df.where(~is_test(id_col, seed))


def test_part(df: DataFrame, id_col: str = "id", seed: int = SPLIT_SEED) -> DataFrame:
    return df.where(is_test(id_col, seed))


def fold_of(id_col="id", k: int = CV_FOLDS, seed: int = SPLIT_SEED) -> Column:
    """Fold number 0..k-1 from an independent md5 slice of the id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(c.cast("string"), F.lit(f"|fold|{seed}")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % k).cast("int")


def fold_sql(id_col: str = "id", k: int = CV_FOLDS, seed: int = SPLIT_SEED) -> str:
    return f"cast((('0x' || substring(md5(concat({id_col}, '|fold|{seed}')), 1, 8))::BIGINT) % {k} as int)"


def _draw(row: Column, column: int, seed: int, part: int) -> Column:
    """A number in (0, 1) that depends on row, column and seed alone, however the rows are partitioned."""
    h = F.md5(F.concat_ws("|", row.cast("string"), F.lit(column), F.lit(seed), F.lit(part)))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(16 ** 12)


def sample_rows(profile_rows: list[dict], n: int, seed: int = 42, spark=None) -> DataFrame:
    """``n`` synthetic rows from a column profile (G8 rows).

    Binary columns: Bernoulli(mean clipped to [0, 1]); others Normal(mean, std)
    by Box-Muller, clipped at 0 when the column is non-negative. Draws are hashes
    of (row, column, seed); rows are generated on the executors from ``range(n)``.
    """
    cols = []
    for i, p in enumerate(profile_rows):
        u, v = _draw(F.col("id"), i, seed, 0), _draw(F.col("id"), i, seed, 1)
        if p["binary"]:
            prob = min(max(float(p["mean"]), 0.0), 1.0)
            cols.append((u < F.lit(prob)).cast("double").alias(p["col"]))
        else:
            z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
            x = F.lit(float(p["mean"])) + F.lit(float(p["std"])) * z
            if p["non_negative"]:
                x = F.greatest(x, F.lit(0.0))
            cols.append(x.alias(p["col"]))
    return spark.range(n).select(F.col("id").alias("row_id"), *cols)
