"""Fingerprints of tables and the difference of two versions, for backups that can be checked and restored."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bursar.sources import tables

FINGERPRINTS = "_fingerprints"
_SCHEMA = "name string, n_rows long, content string"


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and a hash of the content that does not depend on the order or the files: the sums of two 64-bit row hashes.

    Sums, so that a repeated row counts; columns go in by name, nulls and empty texts apart.
    """
    cols = sorted(df.columns)
    marked = [c for name in cols for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *marked).cast("decimal(38,0)")), F.lit(0)).cast("string")
    r = df.agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    return r.n, f"{'|'.join(cols)}:{r.a}:{r.b}"


def backup(named: Mapping[str, DataFrame], dest: str, date: str) -> dict[str, str]:
    """S13 with a fingerprint of every table beside it, taken of the tables and not of the copies."""
    spark = next(iter(named.values())).sparkSession
    paths = tables.snapshot(named, dest, date)
    rows = [(name, *fingerprint(df)) for name, df in named.items()]
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{dest}/{date}/{FINGERPRINTS}")
    return paths


def damaged(spark: SparkSession, dest: str, date: str) -> list[str]:
    """Names of the backup's tables whose copies cannot be read or differ from what was backed up."""
    bad = []
    for r in spark.read.schema(_SCHEMA).parquet(f"{dest}/{date}/{FINGERPRINTS}").orderBy("name").collect():
        try:
            same = fingerprint(spark.read.parquet(f"{dest}/{date}/{r.name}")) == (r.n_rows, r.content)
        except AnalysisException:
            same = False
        if not same:
            bad.append(r.name)
    return bad


def restore(spark: SparkSession, dest: str, date: str, root: str, version: str) -> str:
    """Publishes a backup's tables under ``root`` as one version, if all copies are whole."""
    bad = damaged(spark, dest, date)
    if bad:
        raise ValueError(f"backup {date!r} is damaged: {', '.join(bad)}")
    names = [r.name for r in spark.read.schema(_SCHEMA).parquet(f"{dest}/{date}/{FINGERPRINTS}").collect()]
    return tables.publish({n: spark.read.parquet(f"{dest}/{date}/{n}") for n in names}, root, version)


def differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key``, change ('added', 'removed' or 'changed') and the changed columns of every row that differs; ``key`` is unique.

    Rows are compared by one hash of each side's values first, so unchanged rows carry two numbers through the join, and
    their values are not shuffled. The changed rows alone are then compared column by column.
    """
    cols = [c for c in old.columns if c != key]
    mark = lambda df, name: df.select(key, F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))]).alias(name))
    both = mark(old, "a").join(mark(new, "b"), key, "full")
    change = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed"))
    found = both.select(key, change.alias("change")).filter("change is not null")
    changed = found.filter("change = 'changed'").select(key)
    was = old.join(changed, key, "left_semi").select(key, F.struct(*cols).alias("was"))
    now = new.join(changed, key, "left_semi").select(key, F.struct(*cols).alias("now"))
    names = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(c)) for c in cols))), ",")
    return (found.filter("change <> 'changed'").select(key, "change", F.lit("").alias("columns"))
            .unionByName(was.join(now, key).select(key, F.lit("changed").alias("change"), names.alias("columns"))))
