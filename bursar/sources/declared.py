"""Declared tables in the shared warehouse, bucketed by the key they are joined on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bursar.sources import schemas
from bursar.sources.tables import conform

#: Columns that a school table is bucketed by: the joins of the balance and history pages then need no shuffle of it.
BUCKETED_BY = {"students": "student_id", "fee_payments": "student_id", "fee_discounts": "student_id", "uniform_issues": "student_id",
               "uniform_items": "uniform_id"}


def declare(spark: SparkSession, name: str, database: str = "default", buckets: int = 64, path: str | None = None) -> str:
    """CREATE TABLE IF NOT EXISTS for a school table, with its declared schema and buckets; its name in the catalog.

    Every table joined on the same key needs the same number of ``buckets``: about the size of the largest divided by
    128-256 MB. With ``path`` the files lie there and not in the warehouse.
    """
    table = f"`{database}`.`{name}`"
    key = BUCKETED_BY.get(name)
    clause = f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key else ""
    where = f" LOCATION '{path}'" if path else ""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.TABLES[name])
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{clause}{where}")
    return f"{database}.{name}"


def append(rows: DataFrame, name: str, database: str = "default") -> None:
    """Adds rows to a declared table, in its buckets."""
    key = BUCKETED_BY.get(name)
    out = conform(rows, schemas.TABLES[name])
    # One file a bucket and append, not one a bucket and task.
    out = out.repartition(_buckets(rows.sparkSession, name, database), key) if key else out
    out.write.insertInto(f"{database}.{name}")


def _buckets(spark: SparkSession, name: str, database: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{name}`").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type)


def table(spark: SparkSession, name: str, database: str = "default") -> DataFrame:
    return spark.table(f"{database}.{name}")
