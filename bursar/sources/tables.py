"""Scans and sinks.

Every scan returns the declared schema (``schemas.TABLES``): columns are selected by name and cast, so
callers never see storage types (e.g. doubles for money) and column pruning reaches the parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from bursar.sources import schemas


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Project ``df`` onto a declared schema: cast present columns, add absent nullable ones as null."""
    if isinstance(schema, str):
        schema = schemas.TABLES[schema]
    present = {c.lower(): c for c in df.columns}
    cols = []
    for field in schema.fields:
        src = present.get(field.name.lower())
        if src is None:
            if not field.nullable:
                raise ValueError(f"required column {field.name!r} is missing")
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            cols.append(F.col(src).cast(field.dataType).alias(field.name))
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan one table from parquet and conform it to its declared schema."""
    return conform(spark.read.parquet(path), name)


def students(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "students")


def classes(spark: SparkSession, path: str) -> DataFrame:
    """S2; ``operators.lists.class_list`` gives the class_id order."""
    return read_table(spark, path, "classes")


def terms(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "academic_terms")


def fee_payments(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "fee_payments")


def fee_discounts(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "fee_discounts")


def boarding_fee(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "boarding_fee")


def fee_defaults(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "fee_defaults")


def uniform_items(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "uniform_items")


def uniform_issues(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "uniform_issues")


def staff_roster(spark: SparkSession, path: str) -> DataFrame:
    """Only roster columns are selected, so a password-hash column is never read."""
    return read_table(spark, path, "users")


def ensure_table(spark: SparkSession, name: str, path: str,
                 schema: T.StructType | None = None) -> DataFrame:
    """CREATE TABLE IF NOT EXISTS for a parquet folder; returns the (possibly empty) table."""
    schema = schema or schemas.TABLES[name]
    try:
        return conform(spark.read.parquet(path), schema)
    except AnalysisException:
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)
        return spark.read.schema(schema).parquet(path)


def write_version(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a new table version to a fresh folder (never in place: parquet has no UPDATE)."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


MANIFEST = "_current"
#: A table's name with this mark stands for rows added to it.
ADDED = "+"


def write_versions(tables: Mapping[str, DataFrame], root: str, version: str) -> dict[str, str]:
    """Write several tables of one change set under ``root/version/<name>`` and return their paths.

    The previous version is left untouched, and readers do not see the new one before ``publish``
    points to it. A retry after a failure overwrites what the unfinished attempt left; a published
    version is never written again.
    """
    if tables:
        spark = next(iter(tables.values())).sparkSession
        if version in published(spark, root):
            raise ValueError(f"version {version!r} is published")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    return {name: f"{root}/{version}/{name}" for name in tables}


_ENTRY = "at bigint, version string, name string"


def _manifest(spark: SparkSession, root: str) -> list:
    """(at, version, table name) of what is published, the first one first."""
    try:
        return spark.read.schema(_ENTRY).parquet(f"{root}/{MANIFEST}").orderBy("at").collect()
    except AnalysisException:
        return []


def published(spark: SparkSession, root: str) -> list[str]:
    """Published versions, the first one first."""
    return list(dict.fromkeys(r.version for r in _manifest(spark, root)))


def publish(tables: Mapping[str, DataFrame], root: str, version: str) -> str:
    """Write a change set and then, in one small append, make it current: all of its tables or none."""
    spark = next(iter(tables.values())).sparkSession
    write_versions(tables, root, version)
    at = len(published(spark, root))
    entry = spark.createDataFrame([(at, version, name) for name in tables], _ENTRY)
    entry.coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return version


def current_path(spark: SparkSession, root: str, name: str) -> str:
    """Where readers find a table: in the latest published version that has it."""
    versions = [r.version for r in _manifest(spark, root) if r.name == name]
    if not versions:
        raise ValueError(f"{name!r} is not published under {root}")
    return f"{root}/{versions[-1]}/{name}"


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as readers see it: its latest published version, and the rows published as additions since."""
    paths: list[str] = []
    for r in _manifest(spark, root):
        if r.name == name:
            paths = [f"{root}/{r.version}/{name}"]
        elif r.name == name + ADDED:
            paths.append(f"{root}/{r.version}/{name}{ADDED}")
    if not paths:
        raise ValueError(f"{name!r} is not published under {root}")
    return conform(spark.read.schema(schemas.TABLES[name]).parquet(*paths), name)


def key_bounds(spark: SparkSession, path: str, key: str) -> tuple[int, int] | None:
    """Smallest and largest key of a Parquet table, from the footers of its files: no row is read. None: no rows."""
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = spark.read.parquet(path).agg(F.min(key), F.max(key)).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return None if found[0] is None else (found[0], found[1])


def snapshot(tables: Mapping[str, DataFrame], dest: str, date: str) -> dict[str, str]:
    """Copy every table to ``dest/date/<name>`` (the reference's manual backup)."""
    return write_versions(tables, dest, date)
