"""Batch change jobs driven by a command stream (``foreachBatch``).

Each micro-batch of commands is applied with the same ``apply_*`` job as in batch mode, to the table
version the previous micro-batch wrote; the new version goes to ``root/v<batch_id>`` and the rejects
to ``root_rejects/batch_id=<batch_id>``. Both are written in overwrite mode under names fixed by the
batch id, so a micro-batch replayed after a failure rewrites the same folders with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bursar.sources.tables import conform


def version_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/v{batch_id:010d}"


def apply_stream(commands: DataFrame, job: Callable[[DataFrame, DataFrame], object], *,
                 initial_path: str, root: str, table_schema, checkpoint: str,
                 append: bool = False, available_now: bool = True) -> StreamingQuery:
    """Run ``job(base, batch) -> Applied`` for every micro-batch of a streaming command DataFrame.

    ``append=False``: each micro-batch writes the whole new version to ``root/v<batch_id>``.
    ``append=True`` (insert-only jobs): each micro-batch writes only its new rows to
    ``root/batch_id=<batch_id>``; the table is the initial folder plus every batch folder, and the base
    of batch b is the initial table plus batches before b.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        if append:
            base = conform(spark.read.parquet(initial_path), table_schema)
            if batch_id > 0:
                earlier = spark.read.parquet(root).filter(F.col("batch_id") < batch_id)
                base = base.unionByName(conform(earlier, table_schema))
        else:
            src = initial_path if batch_id == 0 else version_path(root, batch_id - 1)
            base = conform(spark.read.parquet(src), table_schema)
        result = job(base, batch)
        if append:
            result.added.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch_id={batch_id}")
        else:
            result.table.write.mode("overwrite").parquet(version_path(root, batch_id))
        (result.rejects.withColumn("batch_id", F.lit(batch_id))
               .write.mode("overwrite").parquet(f"{root.rstrip('/')}_rejects/batch_id={batch_id}"))

    writer = commands.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def appended_table(spark: SparkSession, initial_path: str, root: str, table_schema) -> DataFrame:
    """The current table of an ``append=True`` stream: the initial rows plus every batch's rows."""
    base = conform(spark.read.parquet(initial_path), table_schema)
    return base.unionByName(conform(spark.read.parquet(root), table_schema))
