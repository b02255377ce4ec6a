"""Sources and sinks S1–S7: CSV and Parquet round trips, the JSON stats table,
model persistence, the cascading default table, the model registry and the
options catalogue. Written files go to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_AVERAGES, DEFAULT_MODEL_REPORTS, DEFAULT_MODEL_SERVING, PREFERRED_MODELS
from ..functions.text import json_list
from ..session import scratch_path


def write_csv(df: DataFrame, path: str) -> None:
    """Header, quoted multi-line text, blanks at the ends of a text kept, overwrite."""
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Explicit schema (no inference), header, multi-line quoted fields; empty -> null, never NaN.

    A file with line ends inside quotes is one task; ``csv_split.read_csv_splits`` reads it in many.
    ``multi_line=False`` also splits; it is for files known to have none, and a record cut by one is an error.
    """
    return (
        spark.read.schema(schema)
        .option("header", True).option("multiLine", multi_line).option("escape", '"')
        .option("nullValue", "").option("mode", "FAILFAST")
        .csv(path)
    )


def csv_roundtrip(spark: SparkSession, df: DataFrame, schema: str) -> DataFrame:
    """S1 + S2: land a table as CSV and read it back with an explicit schema."""
    path = scratch_path(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path, schema)


def parquet_roundtrip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """S2 (Parquet form): write, read back. Also the way to cut lineage on a cluster."""
    path = scratch_path(spark, "parquet")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread_roundtrip(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``parquet_roundtrip`` in at least as many files as there are cores.

    Adaptive execution may end a small plan in a single task, and a file of one row group is read by
    one task however many splits it has: every later pass would run on one core. Such a table is dealt
    out again, round robin, so that repeated or null keys don't gather in one file.
    """
    table, cores = parquet_roundtrip(spark, df), spark.sparkContext.defaultParallelism
    if len(table.inputFiles()) < cores:
        table = parquet_roundtrip(spark, table.repartition(2 * cores))
    return table


STATS_SCHEMA = ", ".join(f"{k} double" for k in DEFAULT_AVERAGES)


def write_stats(df: DataFrame, path: str) -> None:
    """S3 sink: the one-row name->double table as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """S3 source with the fixed 13-key schema."""
    return spark.read.schema(STATS_SCHEMA).json(path)


def load_defaults(spark: SparkSession, stats_path: str | None, raw: DataFrame | None = None) -> DataFrame:
    """The stats file -> else means of the raw listings -> else the fixed constants.

    A missing or empty file and absent listings lead to the next level; any other
    storage error is raised, so that it cannot change the defaults unseen. Missing
    keys are filled from the constants.
    """
    from ..operators.aggregates import raw_means

    table = None
    if stats_path:
        try:
            table = read_stats(spark, stats_path).limit(1)
            table = None if table.isEmpty() else table
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if table is None and raw is not None:
        table = raw_means(raw)
    if table is None:
        table = spark.createDataFrame([tuple(DEFAULT_AVERAGES.values())], STATS_SCHEMA)
    return table.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in DEFAULT_AVERAGES.items()])


def defaults_dict(table: DataFrame) -> dict[str, float]:
    """The one-row default table as a dict (13 scalars)."""
    return table.first().asDict()


def save_model(model, path: str) -> str:
    """S4 sink: Spark ML persistence."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """S4 source."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def choose_model(metrics: DataFrame, rule: str = "serving", available: list[str] | None = None) -> DataFrame:
    """Pick one model from ``(model, rmse)``.

    ``serving``: preferred names first (if available), then the lowest RMSE;
    ``reports``: lowest RMSE only. Ties by name. Without any metrics the rule's
    default name is returned, with a null RMSE.
    """
    m = metrics
    if available is not None:
        m = m.where(F.col("model").isin(*available))
    if rule == "serving":
        pref = F.lit(len(PREFERRED_MODELS))
        for i, name in reversed(list(enumerate(PREFERRED_MODELS))):
            pref = F.when(F.col("model") == name, F.lit(i)).otherwise(pref)
        m = m.withColumn("_pref", pref).orderBy("_pref", "rmse", "model").drop("_pref")
    else:
        m = m.orderBy("rmse", "model")
    best = m.limit(1)
    if best.isEmpty():
        name = DEFAULT_MODEL_SERVING if rule == "serving" else DEFAULT_MODEL_REPORTS
        return best.sparkSession.createDataFrame([(name, None)], "model string, rmse double")
    return best


def options(listings: DataFrame) -> DataFrame:
    """Allowed values per categorical field, from the data (amenities exploded)."""
    def field(name: str, col: str) -> DataFrame:
        return listings.select(F.lit(name).alias("field"), F.col(col).alias("value")).where(F.col("value").isNotNull())

    amen = listings.select(F.lit("amenity").alias("field"), F.explode(json_list("amenities")).alias("value")).where(
        F.col("value").isNotNull())
    return (
        field("room_type", "room_type")
        .unionByName(field("neighbourhood", "neighbourhood_group_cleansed"))
        .unionByName(field("property_type", "property_type"))
        .unionByName(amen)
        .distinct()
    )

