"""Intermediate tables whose size the planner knows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from bursar.session import ensure_checkpoint_dir


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet and read again.

    A frame made in memory, of a micro-batch or behind a checkpoint has no size statistics, so a join would
    shuffle the large side to be safe. From the files the planner knows the size: it broadcasts up to
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond. The files also survive lost executors.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
