"""Sinks (A3-A8): parquet for tables, header CSV for figure datasets, JSON for the warehouse record."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """A3 / A4 / A5: one parquet dataset, in zstd; ``partition_by`` for one dataset over many outcomes."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Figure datasets as CSV with a header (one folder of part files)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """The warehouse count record."""
    df.write.mode(mode).json(path)
    return path


def write_partitions(df: DataFrame, path: str, by: str) -> str:
    """A5: replace, in the dataset at ``path``, the partitions of ``by`` that ``df`` has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return path


def write_by_month(df: DataFrame, path: str, date: str, mode: str = "overwrite") -> str:
    """A warehouse table in one folder per month of ``date`` (``month=2001-05-01``); ``load_parquet`` prunes them."""
    df.withColumn("month", F.trunc(F.col(date).cast("date"), "month")).write.mode(mode).partitionBy("month").parquet(path)
    return path


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int, mode: str = "overwrite") -> str:
    """A dataset dealt into ``buckets`` by a hash of ``by``, one sorted file per bucket."""
    table = f"written_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, by)  # the bucket of a row is its shuffle partition, so a task writes one file
    dealt.write.mode(mode).format("parquet").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    df.sparkSession.sql(f"drop table {table}")  # an external table: the files stay
    return path


def read_bucketed(spark: SparkSession, table: str, path: str, schema: T.StructType, by: str, buckets: int) -> DataFrame:
    """The dataset of ``write_bucketed``, as a table that tells Spark how it is dealt (also in a later session)."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"create table if not exists {table} ({columns}) using parquet clustered by (`{by}`) sorted by (`{by}`) into {buckets} buckets location '{path}'")
    return spark.table(table)
