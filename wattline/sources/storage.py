"""Panels laid out for what is done with them later.

* Bucketed tables deal rows by a hash of site and time when they are written, into one file per
  bucket.  Tables with the same number of buckets join on both columns where they lie, without
  an exchange on either side.
* Partitioned tables keep readings by month and site bucket.  A later export rewrites only
  the partitions that it has readings for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import drop_duplicate_readings
from .sinks import shared_dir, stage

KEYS = ("site_id", "timestamp")
# Columns that name a partition.
BUCKET, MONTH = "site_bucket", "month_start"
SITE_BUCKETS = 64


def write_bucketed(df: DataFrame, path: str, buckets: int, keys: tuple[str, ...] = KEYS) -> str:
    """Write a table dealt by ``keys`` into ``buckets`` files, each sorted by them.

    Choose as many buckets as make files of a few hundred megabytes, and the same number for tables
    that are joined.  Site and time together spread a site of any size.  Rows without a site or a
    time are kept.
    """
    name = _new_name()
    (
        df.repartition(buckets, *keys)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", str(path))
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .saveAsTable(name)
    )
    # Only the files are kept; every session names them for itself.
    df.sparkSession.sql(f"DROP TABLE {name}")
    return str(path)


def read_bucketed(spark: SparkSession, path: str, buckets: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A table that ``write_bucketed`` wrote with the same ``buckets`` and ``keys``."""
    name = _new_name()
    schema = spark.read.parquet(str(path)).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS"
    )
    return spark.table(name)


def _new_name() -> str:
    return f"wattline_{uuid.uuid4().hex}"


def with_partitions(df: DataFrame, buckets: int = SITE_BUCKETS) -> DataFrame:
    """Add the columns that name a row's partition.

    The month is of the instant in UTC, whatever the session's zone; rows without a time have none.
    """
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("floor(unix_micros(timestamp) / 86400000000D)").cast("int"))
    return df.withColumns(
        {
            BUCKET: F.pmod(F.xxhash64("site_id"), F.lit(buckets)).cast("int"),
            MONTH: F.date_format(F.trunc(days, "month"), "yyyy-MM"),
        }
    )


def _write(df: DataFrame, path: str, mode: str) -> None:
    # Rebalancing splits the partition of a large site over several files and joins small ones.
    laid_out = df.hint("rebalance", BUCKET, MONTH).sortWithinPartitions(BUCKET, MONTH, *KEYS)
    writer = laid_out.write.mode("overwrite").partitionBy(BUCKET, MONTH).option("partitionOverwriteMode", mode)
    writer.parquet(str(path))


def write_readings(df: DataFrame, path: str, buckets: int = SITE_BUCKETS) -> str:
    """Write readings, the last of each site and time, by site bucket and month."""
    _write(with_partitions(drop_duplicate_readings(df), buckets), path, "static")
    return str(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings as stored, without the columns that name their partition."""
    return spark.read.parquet(str(path)).drop(BUCKET, MONTH)


def merge_export(spark: SparkSession, path: str, export: DataFrame, buckets: int = SITE_BUCKETS) -> int:
    """Put a later export into stored readings; returns the number of partitions rewritten.

    Readings of the export replace stored ones of the same site and time, whatever their own
    order; within the export the last one counts.  Only partitions that the export touches are read
    and written, the files of all others stay as they are.  The new content of those is
    stored first, so the stored table is replaced only when everything is there.  The result is what
    rewriting the table from all exports gives.
    """
    later = stage(with_partitions(drop_duplicate_readings(export), buckets))
    touched = later.select(BUCKET, MONTH).distinct()
    stored = spark.read.option("basePath", str(path)).parquet(str(path)).withColumn(BUCKET, F.col(BUCKET).cast("int"))
    stored = stored.withColumn(MONTH, F.col(MONTH).cast("string"))
    # A row per partition: at most buckets times months.
    here = F.broadcast(touched.select(F.col(BUCKET).alias("b"), F.col(MONTH).alias("m")))
    old = stored.join(here, (F.col(BUCKET) == F.col("b")) & F.col(MONTH).eqNullSafe(F.col("m")), "left_semi")
    both = old.withColumn("__later", F.lit(0)).unionByName(later.withColumn("__later", F.lit(1)))
    kept = drop_duplicate_readings(both, order_by="__later").drop("__later")
    _write(stage(kept, shared_dir(spark)), path, "dynamic")
    return touched.count()
