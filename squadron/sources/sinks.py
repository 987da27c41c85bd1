"""Sinks K1-K6.

All writes are distributed (one task per partition); nothing passes through
the driver.  The reference's chunked inserts become ``maxRecordsPerFile``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append(df: DataFrame, path: str, partition_by=None, max_records_per_file: int | None = None) -> None:
    """K1 / K4: append (player info, participants, weekly entries)."""
    w = df.write.mode("append")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """K2: replace the whole table (fixtures)."""
    df.write.mode("overwrite").parquet(path)


def refresh_gameweeks(df: DataFrame, path: str) -> None:
    """K3 (Q17 fixed): idempotent refresh of the gameweeks present in
    ``df``.  Dynamic partition overwrite replaces exactly those
    ``gameweek=<n>`` partitions and leaves the others; running it twice
    equals running it once."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("gameweek").parquet(path))


def refreshed(old: DataFrame, new: DataFrame, key: str = "gameweek") -> DataFrame:
    """K3 in SQL-visible form: old rows of gameweeks not in ``new``, plus
    ``new`` (left anti join on the distinct refreshed keys + union)."""
    weeks = new.select(key).distinct()
    kept = old.join(weeks, key, "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def bucketed(df: DataFrame, path: str, by, buckets: int) -> DataFrame:
    """K4 / K6: write ``df`` as a table at ``path`` that is bucketed and sorted by
    ``by``; returns the table.  Joins and aggregates on these columns find their
    rows together, so they need no exchange on its side.  ``buckets`` must be the
    same for tables that meet."""
    by = list(by)
    name = f"bucketed_{uuid.uuid4().hex}"
    # One task per bucket writes one file per bucket.
    (df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).format("parquet")
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def newest_rows(rows: DataFrame, key, version) -> DataFrame:
    """K3 with versions: one row per ``key``, the one with the greatest
    ``version`` columns, in whatever order the rows came.  A partial aggregate."""
    key, version = list(key), list(version)
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r"))
    return best.select(*[F.col(c) if c in key else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def write_json(df: DataFrame, path: str, column: str | None = None) -> None:
    """K5: reports as JSON -- either a column already holding JSON text
    (one document per line) or every row serialised by Spark."""
    if column:
        df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    else:
        df.write.mode("overwrite").json(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType, partition_by=None) -> DataFrame:
    """K6: create an empty typed table if absent, then return it."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        w = spark.createDataFrame([], schema).write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(path)
    return spark.read.schema(schema).parquet(path)
