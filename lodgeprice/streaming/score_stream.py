"""Score request files as they arrive, with Structured Streaming.

Stateless: each micro-batch goes through the batch scorer (U4) in
``foreachBatch``. Each batch is written to its own ``batch_id=<n>`` folder with
overwrite, so a retried batch (after executor or driver loss) replaces its own
output instead of duplicating it; progress is kept in the checkpoint folder.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def score_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint_dir: str, schema: StructType,
                 scorer: Callable[[DataFrame], DataFrame], available_now: bool = True):
    """Start (and with ``available_now`` run to completion) the scoring stream; returns the query."""
    src = spark.readStream.schema(schema).parquet(in_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))

    writer = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
