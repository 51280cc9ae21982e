"""Sharding by longest-processing-time scheduling: equal texts stay together, shards get equal bytes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bursar.llm.common import cut

#: The largest groups, placed one by one; bounds what the driver and a broadcast hold.
HEAD_GROUPS = 4096
#: All smaller groups are packed by their key into so many parcels, which are placed like groups.
PARCELS = 8192


def longest_first(sizes: list[tuple[int, str]], n_shards: int) -> dict[str, int]:
    """Largest item first (ties by name), each to the least loaded shard (ties: the lowest number)."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, seen = TaskContext.get().partitionId(), {}
    for pdf in batches:
        if not len(pdf):
            continue
        start = pdf["shard"].map(lambda s: seen.get(s, 0))
        pdf["place"] = pdf.groupby("shard").cumcount().astype("int64") + start
        for shard, n in pdf["shard"].value_counts().items():
            seen[shard] = seen.get(shard, 0) + int(n)
        pdf["part"] = part
        yield pdf


def shard_by_bytes(documents: DataFrame, n_shards: int = 8, head_groups: int = HEAD_GROUPS,
                   parcels: int = PARCELS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``documents``.

    Rows with equal texts form a group (null counts as the empty text). Group sizes are summed with
    map-side combining, so a group with a third of all rows is a sum like any other. The
    ``head_groups`` largest groups and ``parcels`` hash parcels of all smaller groups are sorted by
    size, and a heap gives each to the least loaded shard; shards then differ by about a parcel at
    most, unless one group alone is larger than a shard's share. Up to ``head_groups`` groups this is
    exactly the serial schedule. The driver holds ``head_groups + parcels`` sizes at any input.

    Slots number each shard's rows from 0 without gaps: rows are numbered inside their written
    partition, and partition offsets are running sums over (partition, shard) counts. Null ids are
    kept, repeated rows are rows of the same group, and an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = cut(documents.select(
        F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    head = groups.orderBy(F.desc("bytes"), "key").limit(head_groups).collect()
    parcel = F.pmod(F.xxhash64("key"), F.lit(parcels)).cast("int")
    rest = []
    if len(head) == head_groups:
        last = head[-1]
        below = (F.col("bytes") < last.bytes) | ((F.col("bytes") == last.bytes) & (F.col("key") > last.key))
        rest = groups.filter(below).groupBy(parcel.alias("parcel")).agg(F.sum("bytes").alias("bytes")).collect()
    placed = longest_first([(r.bytes, r.key) for r in head] + [(r.bytes, f"parcel {r.parcel}") for r in rest],
                           n_shards)
    spark = documents.sparkSession
    # Both sides are bounded by head_groups and parcels.
    of_head = spark.createDataFrame([(r.key, placed[r.key]) for r in head], "key string, head_shard int")
    of_parcel = spark.createDataFrame([(r.parcel, placed[f"parcel {r.parcel}"]) for r in rest],
                                      "parcel int, parcel_shard int")
    shard = (rows.withColumn("parcel", parcel)
             .join(F.broadcast(of_head), "key", "left").join(F.broadcast(of_parcel), "parcel", "left")
             .select("doc_id", "size", "text_crc32", F.coalesce("head_shard", "parcel_shard").alias("shard")))
    id_type = shard.schema["doc_id"].dataType.simpleString()
    numbered = cut(shard.mapInPandas(_number, f"doc_id {id_type}, size long, text_crc32 long, shard int, "
                                              "place long, part int"))
    counts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (numbered.join(offsets, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
