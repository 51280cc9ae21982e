"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bursar.session import ensure_checkpoint_dir

#: Characters of one numpy step inside a task: bounds the temporary arrays whatever the batch holds.
STEP_CHARS = 4_000_000


_BUILT: dict = {}


def built(key, build: Callable):
    """What ``build`` made for ``key`` in this Python worker, which runs many tasks; only the latest is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def freed(spark: SparkSession) -> None:
    """The driver collects its garbage, so that Spark removes the shuffle files of finished work."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def cut(df: DataFrame, free: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    With ``free`` the driver then collects its garbage: Spark removes the shuffle files of the work that led
    here once nothing refers to it any more, and else they stay on disk until the driver happens to.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    if free:
        freed(spark)
    return out


def cut_unsized(df: DataFrame, free: bool = True) -> DataFrame:
    """``cut``, whose rows begin without an estimate of their size, so that only measured ones are broadcast.

    Else they keep that of their plan: far too low after an explode, and the product of both sides after a join, a number
    whose digits multiply with each round of joins, on the driver.
    """
    spark = df.sparkSession
    done = cut(df, free)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().analyzed().rdd(), done.schema(), False), spark)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` (in place of what is there) as compressed Parquet, and read again."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    del df
    freed(spark)
    return spark.read.parquet(path)


def unsized(df: DataFrame) -> DataFrame:
    """``df`` for a join in which neither side is broadcast: to Spark's estimate, the size of compressed files times the
    share of the columns' nominal widths, a table of many narrow rows looks small at any size."""
    return df.hint("merge")


@contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = 8):
    """Rows with blocks of megabytes are read and sent to Python ``rows`` at a time by the actions inside."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, str(rows))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Texts go to Python ``rows`` at a time, unless the session asks for something else than Spark's default."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, "10000") == "10000":
        conf.set(key, str(rows))


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def steps(batches: Iterator[pd.DataFrame], column: str = "text",
          chars: int = STEP_CHARS) -> Iterator[pd.DataFrame]:
    """Slices of the batches with about ``chars`` characters each; a longer text is a slice of its own."""
    for pdf in batches:
        if not len(pdf):
            continue
        before = pdf[column].str.len().fillna(0).astype("int64").cumsum()
        for _, part in pdf.groupby((before // chars).to_numpy(), sort=True):
            yield part


def components(edges: DataFrame, a: str = "a", b: str = "b", node: str = "node",
               component: str = "component", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b of type long) can reach.

    Large-star / small-star: every round links neighbours above a node, then those below it, to the
    smallest neighbour, until nothing moves, in a logarithmic number of rounds. Minima are combined
    before the shuffle, and the joins back are left to skew handling. Each round is cut into the
    checkpoint folder; the driver only sees one checksum per round. Nodes without an edge to another
    node are absent.
    """
    links = cut_unsized(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .filter("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written, so that the joins deal both sides out anew and can split a node with many links.
        low = cut_unsized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), free=False)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_unsized(large.filter("u > v").distinct(), free=False)
        low = cut_unsized(large.groupBy("u").agg(F.min("v").alias("m")), free=False)
        joined = large.join(low, "u")
        links = cut_unsized(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(joined.select("u", F.col("m").alias("v")))
                    .filter("u > v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.groupBy("u").agg(F.min("v").alias("m"))
    return (stars.select(F.col("u").alias(node), F.col("m").alias(component))
            .unionByName(stars.select(F.col("m").alias(node), F.col("m").alias(component)).distinct()))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by ``keys``, each whole; memory holds a batch and a group."""
    open_parts: list[pd.DataFrame] = []
    open_key = None
    for pdf in batches:
        if not len(pdf):
            continue
        values = [pdf[k].to_numpy() for k in keys]
        change = np.zeros(len(pdf), bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(starts, starts[1:]):
            key = tuple(v[a] for v in values)
            if open_parts and key != open_key:
                yield open_parts[0] if len(open_parts) == 1 else pd.concat(open_parts, ignore_index=True)
                open_parts = []
            open_key = key
            open_parts.append(pdf.iloc[a:b])
    if open_parts:
        yield open_parts[0] if len(open_parts) == 1 else pd.concat(open_parts, ignore_index=True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between 0..n-1, as many as join the same components: at most n - 1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
            if len(out) == n - 1:
                break
    return out


def block_pairs(df: DataFrame, size: str, row: str, block: int, seed: int) -> DataFrame:
    """Every row once for each pair of blocks (i, j), i <= j, that its block is part of.

    A group of ``size`` rows is cut into ceil(size / block) blocks by a hash of ``row``; any two rows of a
    group meet in the pair of their blocks, once. ``mine`` tells the row's own block.
    """
    return (df.withColumn("blocks", F.ceil(F.col(size) / block).cast("int"))
            .withColumn("mine", F.pmod(F.xxhash64(F.lit(seed), row), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
            .drop("blocks", "other"))


def aside(df: DataFrame, taken: Callable[[str], bool]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns whose names are ``taken`` renamed, and what gives back its columns and names."""
    names = {}
    for c in df.columns:
        new = f"aside_{c}"
        while taken(c) and (new in df.columns or new in names.values()):
            new += "_"
        names[c] = new if taken(c) else c
    back = lambda out: out.select(*(F.col(f"`{new}`").alias(c) for c, new in names.items()))
    return df.select(*(F.col(f"`{c}`").alias(new) for c, new in names.items())), back
