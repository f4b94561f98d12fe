"""Registry of named queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaktrail.session import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``ids`` lists the survey operators it covers."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of spread text work holds, about.
SPREAD_ROWS = 250_000


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for text work where the splits do not; splits of about equal rows are kept.

    Splits are cut by bytes, but a row group belongs to one of them whole: a file of few row groups has many empty ones.
    Counting rows by split reads footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("_split")).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    rows = held["rows"] or 0
    return df.repartition(cores * max(1, rows // (cores * SPREAD_ROWS))) if (held["most"] or 0) * cores > 1.5 * rows else df
