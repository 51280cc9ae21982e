"""Dense row numbers over a whole table, without gathering it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bursar.session import ensure_checkpoint_dir


def positions(df: DataFrame, name: str = "position") -> DataFrame:
    """``df`` with each row's place in the order that it comes in (of a sorted frame: that of the sort), from 1."""
    out = numbered(df.withColumn("_came", F.monotonically_increasing_id()), ["_came"], name)
    return out.drop("_came")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a ``bigint`` column ``name``: 1, 2, ... in the order of ``order`` (nulls first).

    Rows with equal keys get numbers of their own, in the order of a hash of the whole row. The rows are
    range-partitioned and written to the checkpoint folder, so that a rerun task sees the same numbers;
    offsets come from one count per partition, a table bounded by the number of shuffle partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    columns = df.columns
    tie = F.xxhash64(*columns)
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order, tie)
                .withColumn("_part", F.spark_partition_id())
                .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
                .checkpoint(eager=True))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
                     .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (ranged.join(F.broadcast(offsets), "_part")
                  .select(*columns, (F.col("_before") + F.col("_at") + 1).alias(name)))
