"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

#: Words: runs of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """The named columns of one table; other columns are never read."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*[df[c] for c in cols]) if cols else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python at most ``rows`` rows at a time, so that long texts keep a batch small.

    An explicit setting of the session is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    ensure_checkpoint_dir(spark)
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def word_count(text):
    """Number of words of a text column; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text):
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hidden(df: DataFrame, tag: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with every column renamed to ``tag`` and its number, so that none clashes; and the new names."""
    names = {c: f"{tag}{i}" for i, c in enumerate(df.columns)}
    return df.select(*[df[c].alias(n) for c, n in names.items()]), names


def shown(names: dict[str, str]) -> list:
    """The columns of ``hidden`` under their own names again."""
    return [F.col(n).alias(c) for c, n in names.items()]
