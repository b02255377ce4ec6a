"""S1 for large files: quoted multi-line CSV read by many tasks.

A line end inside quotes does not end a record, so whether a line begins one
depends on the quotes of everything before it in the file. The lines are read
split by split; each split counts its own quotes and notes, for both parities
it may begin with, where its last record was opened. One row per split then
settles the parities in file order. A line on its own is a record at once; only
the lines of longer records are grouped, by the place where their record began,
which may lie in an earlier split.

The text must follow RFC 4180: a quote inside a field is doubled and the field
is quoted. Records end with a line feed, with or without a carriage return. The
first record of each file is its header. Empty lines are skipped. A record that
does not parse is an error, as in ``read_csv``. An empty file gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_LINES = "file string, block long, n long, value string, inside int, odd int, opened0 long, opened1 long"


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per line: its number in the split, parities within the split, last opening under either parity.

    The lines of a split come one after the other, so the state carries over between batches.
    """
    split, line, parity, opened = None, 0, 0, [-1, -1]
    for pdf in batches:
        if pdf.empty:
            continue
        change = (pdf["file"] != pdf["file"].shift()) | (pdf["block"] != pdf["block"].shift())
        cuts = np.append(np.flatnonzero(change.to_numpy()), len(pdf))  # the first row always counts as a change
        for start, end in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[start:end]
            here = (part["file"].iloc[0], part["block"].iloc[0])
            if here != split:
                split, line, parity, opened = here, 0, 0, [-1, -1]
            odd = part["value"].str.count('"').to_numpy(np.int64) % 2
            after = (parity + np.cumsum(odd)) % 2
            inside = after ^ odd
            n = line + np.arange(len(part))
            begun = []
            for first in (0, 1):
                opens = np.where((inside == first) & (odd == 1), n, -1)
                begun.append(np.maximum(np.maximum.accumulate(opens), opened[first]))
                opened[first] = int(begun[first][-1])
            line, parity = int(n[-1]) + 1, int(after[-1])
            yield part[["file", "block"]].assign(n=n, value=part["value"], inside=inside.astype("int32"),
                                                 odd=odd.astype("int32"), opened0=begun[0], opened1=begun[1])


def _splits(lines: DataFrame) -> DataFrame:
    """``file, block, first, before``: parity at the split's start, and where the record open there began."""
    per = lines.groupBy("file", "block").agg(
        (F.sum("odd") % 2).cast("int").alias("odd"), F.max("opened0").alias("opened0"), F.max("opened1").alias("opened1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).cast("int")
    last = F.when(F.col("first") == 0, F.col("opened0")).otherwise(F.col("opened1"))
    begun = F.when(last >= 0, F.struct(F.col("block"), last.alias("n")))
    return per.withColumn("first", first).select(
        "file", "block", "first", F.last(begun, ignorenulls=True).over(earlier).alias("before"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record``: the text of every record but the headers, line ends inside quotes kept."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # written once: the splits' summary and both kinds of record read it back, the first without the texts
    folder = scratch_path(spark, "csv-lines")
    text.mapInPandas(_mark, _LINES).write.parquet(folder)
    lines = spark.read.schema(_LINES).parquet(folder)
    known = lines.join(_splits(lines), ["file", "block"]).withColumn("inside", F.col("inside").bitwiseXOR(F.col("first")))
    alone = (F.col("inside") == 0) & (F.col("odd") == 0)
    header = (F.col("block") == 0) & (F.col("n") == 0)
    single = known.where(alone & ~header).select("file", F.col("value").alias("record"))
    opened = F.when(F.col("first") == 0, F.col("opened0")).otherwise(F.col("opened1"))
    # the opening line is its own last opening; a line before any opening goes to an earlier split's record
    begun = F.when(opened >= 0, F.struct("block", opened.alias("n"))).otherwise(F.col("before"))
    longer = (known.where(~alone).select("file", begun.alias("begun"), "block", "n", "value")
              .groupBy("file", "begun").agg(F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("lines"))
              .where((F.col("begun.block") != 0) | (F.col("begun.n") != 0))
              .select("file", F.array_join(F.col("lines.value"), "\n").alias("record")))
    whole = single.unionByName(longer).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return whole.where(F.col("record") != "")


def read_csv_splits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of ``read_csv`` with line ends inside quotes, one large file as many tasks."""
    options = {"escape": '"', "nullValue": "", "mode": "FAILFAST", "multiLine": "true"}
    return records(spark, path).select(F.from_csv("record", schema, options).alias("row")).select("row.*")
