"""F8 for large domains: one sparse vector per category instead of one column per value.

The domain is a table ``(value, slot)``, slots in the order of the values, and
never comes to the driver; rows meet it in a join, which Spark broadcasts only
while it is small. The vectors are made by Spark ML's one-hot encoder, which
needs to know no more than the number of slots. Null and unknown values give a
vector of zeros, as the 0/1 columns do; a column without any value gives vectors
of one zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .aggregates import distinct_table


def write_slots(df: DataFrame, col: str, folder: str) -> None:
    """Write ``(value, slot)`` for the distinct non-null values of a column, numbered in order.

    The values are range-partitioned; a value's slot is its place in its partition
    plus the sizes of the partitions below it, a row each.
    """
    spark = df.sparkSession
    sorted_parts = scratch_path(spark, "slots")
    distinct_table(df, col).select(F.col(col).alias("value")).repartitionByRange("value").withColumn(
        "part", F.spark_partition_id()).write.parquet(sorted_parts)
    parts = spark.read.parquet(sorted_parts)
    sizes = parts.groupBy("part").agg(F.min("value").alias("low"), F.count("*").alias("size"))
    below = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    base = sizes.select("part", F.coalesce(F.sum("size").over(below), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    parts.join(base, "part").select("value", (F.col("base") + place).cast("long").alias("slot")).write.mode(
        "overwrite").parquet(folder)


def vector_column(col: str) -> str:
    return f"{col}_flags"


@dataclass
class SparseOneHot:
    """Slots of several columns, in a folder each, and the encoder of their sizes."""

    folder: str
    columns: list[str]
    sizes: list[int]
    encoder: OneHotEncoderModel

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], folder: str | None = None) -> "SparseOneHot":
        """Number the values of each column and write the slots to ``folder``, where ``load`` finds them."""
        folder = folder or scratch_path(df.sparkSession, "sparse-one-hot")
        for c in columns:
            write_slots(df, c, f"{folder}/{c}")
        return cls.load(df.sparkSession, folder, columns)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, columns: list[str]) -> "SparseOneHot":
        sizes = [spark.read.parquet(f"{folder}/{c}").count() for c in columns]
        encoder = OneHotEncoder(inputCols=[f"_slot_{c}" for c in columns], outputCols=[vector_column(c) for c in columns],
                                handleInvalid="keep", dropLast=True)
        top = spark.range(1).select(*[F.lit(float(max(n, 1) - 1)).alias(f"_slot_{c}") for c, n in zip(columns, sizes)])
        return cls(folder, list(columns), sizes, encoder.fit(top))

    def slots(self, spark: SparkSession, col: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{col}")

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a sparse vector ``<column>_flags`` per fitted column."""
        out = df
        for c, n in zip(self.columns, self.sizes):
            slots = self.slots(df.sparkSession, c).select(F.col("value").alias(f"_value_{c}"), F.col("slot").alias(f"_place_{c}"))
            out = out.join(slots, out[c] == slots[f"_value_{c}"], "left").withColumn(
                f"_slot_{c}", F.coalesce(f"_place_{c}", F.lit(max(n, 1))).cast("double")).drop(f"_value_{c}", f"_place_{c}")
        return self.encoder.transform(out).drop(*[f"_slot_{c}" for c in self.columns])


def active_slots(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Long form ``key, column, size, slot`` of the vectors; a vector of zeros has no row."""
    parts = [df.select(key, F.lit(c).alias("column"), F.unwrap_udt(vector_column(c)).alias("v")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "column", F.col("v.size").alias("size"), F.explode("v.indices").alias("slot"))
