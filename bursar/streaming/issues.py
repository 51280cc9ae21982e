"""Uniform issue requests as a stream: every micro-batch runs the batch fold on the published tables.

The reference decides each request against the stock left at that moment. A micro-batch reads the item and
issue tables of the current published version, so restocks and item edits published by other jobs under
the same root reach it, applies ``stock_fold.issue_uniforms`` (which never gathers an item's requests into one
task) and publishes the items and the added issues as one version named after the batch. A micro-batch replayed after a
failure finds its version published and does nothing, or overwrites what its first attempt left unfinished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bursar.operators.stock_fold import issue_uniforms
from bursar.sources import tables


def issue_stream(requests: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply a streaming request DataFrame to ``uniform_items`` and ``uniform_issues`` published under ``root``.

    Rejects go to ``root_rejects/batch_id=<batch_id>``.
    """

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        version = f"issues-{batch_id:010d}"
        if version in tables.published(spark, root):
            return
        now = {n: tables.current(spark, root, n) for n in ("uniform_items", "uniform_issues")}
        result = issue_uniforms(now["uniform_items"], batch, now["uniform_issues"])
        (result.rejects.withColumn("batch_id", F.lit(batch_id))
               .write.mode("overwrite").parquet(f"{root.rstrip('/')}_rejects/batch_id={batch_id}"))
        # The items as a new version; of the issues only the new rows, so a batch does not rewrite the table.
        tables.publish({"uniform_items": result.items, "uniform_issues" + tables.ADDED: result.issued}, root, version)

    writer = requests.writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
